"""Published pedotransfer regressions as coefficient tables.

Units: sand, clay, silt and organic carbon in percent, bulk density in g/cm3.

A function is a list of projection steps (name -> expression).  A step refers to
the columns of the steps before it instead of repeating their expressions, which
keeps the plan small: nested Column objects are trees and would be copied into
every place that uses them.  ``p`` prefixes all names, so several functions can
be evaluated on the same row.  Steps start from ``BASE``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.functions.numeric import clip, dbl, linear, nn, safe_ln

Steps = list[dict[str, Column]]

VAN_BEMMELEN = 1.72

# --- fixed values: regression coefficients of the published functions --------

SCHOCH = {
    "ths": {"1": 0.919, "bd": -0.355, "clay": 0.000647, "sand": 0.000434, "ln_oc": -0.00229},
    "ln_thr_plus": {"1": -1.56, "bd": -0.217, "clay": 0.0106, "sand": 0.00490},
    "ln_alpha": {"1": -3.84, "bd": -1.32, "clay": 0.0237, "sand": 0.0353, "ln_oc": 0.210},
    "n_inv4": {"1": 0.240, "bd": 0.220, "clay": 0.00291, "sand": -0.00305, "ln_oc": 0.0329},
    "sqrt_tau_plus": {"1": 2.8469, "bd": -0.229, "clay": -0.0106, "sand": -0.00428, "ln_oc": 0.0685},
    "ln_ksat": {"1": 7.45, "bd": -3.16, "clay": -0.0364, "sand": 0.0414, "ln_oc": 0.327},
}

WOSTEN = {
    "ths": {
        "1": 0.7919, "clay": 0.001691, "bd": -0.29619, "silt^2": -1.491e-6, "om^2": 8.21e-5,
        "1/clay": 0.02427, "1/silt": 0.01113, "ln silt": 0.01472, "om clay": -7.33e-5,
        "bd clay": -0.000619, "bd om": -0.001183, "top silt": -1.664e-4,
    },
    "ln_alpha": {
        "1": -14.96, "clay": 0.03135, "silt": 0.0351, "om": 0.646, "bd": 15.29, "top": -0.192,
        "bd^2": -4.671, "clay^2": -0.000781, "om^2": -0.00687, "1/om": 0.0449,
        "ln silt": 0.0663, "ln om": 0.1482, "bd silt": -0.04546, "bd om": -0.4852,
        "top clay": 0.00673,
    },
    "ln_n_minus_1": {
        "1": -25.23, "clay": -0.02195, "silt": 0.0074, "om": -0.1940, "bd": 45.5, "bd^2": -7.24,
        "clay^2": 3.658e-4, "om^2": 0.002885, "1/bd": -12.81, "1/silt": -0.1524,
        "1/om": -0.01958, "ln silt": -0.2876, "ln om": -0.0709, "ln bd": -44.6,
        "bd clay": -0.02264, "bd om": 0.0896, "top clay": 0.00718,
    },
}

WEYNANTS = {
    "ths": {"1": 0.6355, "clay": 0.0013, "bd": -0.1631},
    "ln_alpha": {"1": -4.3003, "clay": -0.0097, "sand": 0.0138, "oc": -0.0992},
    "ln_n_minus_1": {"1": -1.0846, "clay": -0.0236, "sand": -0.0085, "sand^2": 0.0001},
}

PUHLMANN = {
    "ths": {"sqrt oc": 0.015362, "bd": -0.2513, "ln(clay+1)": -0.026836,
            "sqrt sand": -0.0055404, "1": 0.8648},
    "ln_alpha": {"bd^2": -1.187, "sand": -0.031899, "ln(oc+0.1)": -0.58805,
                 "silt^2": -0.00032963, "silt bd": -0.016267, "1": 2.021},
    "ln_n_minus_1": {"sand^2": 0.0003758, "silt": 0.004751, "silt/bd": 0.017826, "1": -2.9804},
}

TEEPE = {
    "ths": {"1": 0.9786, "bd": -0.36686},
    "ln_alpha": {
        "1": 55.576, "bd": -4.433, "silt^2": -0.002, "clay": -0.470, "sand/bd": -0.066,
        "sqrt sand": -3.683, "silt/bd": -0.0359, "sand^2": -0.0016, "sqrt silt": -3.6916,
        "ln sand": 1.8643, "ln silt": 1.575,
    },
    "ln_n_minus_1": {"1": -2.8497, "sand^2": 0.00027395, "silt": 0.01637},
    "awc_vol": {"1": 0.4172514, "bd": 0.1641025, "clay": -0.0012394, "silt": 0.00061115},
}

TOTH = {
    "fc": {"1": 0.2449, "t": -0.1887, "clay": 0.004527, "silt": 0.001535, "silt t": 0.001442,
           "silt clay": -0.00005110, "clay t": 0.0008676},
    "wp": {"1": 0.09878, "clay": 0.002127, "silt": -0.0008366, "t": -0.07670,
           "silt clay": 0.00003853, "clay t": 0.002330, "silt t": 0.0009498},
}

SAXTON_RAWLS = {
    "wilting": {"s": -0.024, "c": 0.487, "om": 0.006, "s om": 0.005, "c om": -0.013,
                "s c": 0.068, "1": 0.031},
    "capacity": {"s": -0.251, "c": 0.195, "om": 0.011, "s om": 0.006, "c om": -0.027,
                 "s c": 0.452, "1": 0.299},
    "drainable": {"s": 0.278, "c": 0.034, "om": 0.022, "s om": -0.018, "c om": -0.027,
                  "s c": -0.584, "1": 0.078},
}

# -----------------------------------------------------------------------------

BASE = {"__sand": dbl, "__clay": dbl, "__oc": dbl, "__bd": dbl}
SOURCE_OF = {"__sand": "sand", "__clay": "clay", "__oc": "soc", "__bd": "trd"}
RETENTION = ("ths", "thr", "alpha", "n")


def run_steps(df: DataFrame, steps: Steps, keep: list[str] | None = None) -> DataFrame:
    """Apply steps on top of the base columns; work columns are dropped again.

    ``keep`` lists the outputs (default: every name without leading ``__``).
    """
    present = [n for n, src in SOURCE_OF.items() if src in df.columns]
    out = df.withColumns({n: BASE[n](SOURCE_OF[n]) for n in present})
    for step in steps:
        out = out.withColumns(step)
    names = [n for step in steps for n in step]
    outputs = [n for n in names if not n.startswith("__")] if keep is None else keep
    kept = [c for c in df.columns if c not in outputs]
    return out.select(*kept, *dict.fromkeys(outputs))


def silt_from(sand: Column, clay: Column, clipped: bool = True) -> Column:
    raw = F.lit(100.0) - sand - clay
    return clip(raw, 0, 100) if clipped else raw


def _silt(clipped: bool = True) -> Column:
    return silt_from(F.col("__sand"), F.col("__clay"), clipped)


def _base() -> dict[str, Column]:
    return {"sand": F.col("__sand"), "clay": F.col("__clay"), "oc": F.col("__oc"), "bd": F.col("__bd")}


def schoch(p: str = "") -> Steps:
    w = f"__{p}"
    terms = {**_base(), "ln_oc": F.col(f"{w}ln_oc")}
    thr, fit = F.col(f"{w}thr"), lambda name: linear(terms, SCHOCH[name])
    inside = lambda c: nn(F.when(thr >= 0, c))
    return [
        {f"{w}ln_oc": safe_ln(F.col("__oc")),
         f"{w}thr": F.exp(linear(_base(), SCHOCH["ln_thr_plus"])) - 0.2},
        {f"{p}ths": inside(fit("ths")), f"{p}thr": inside(thr),
         f"{p}alpha": inside(F.exp(fit("ln_alpha"))),
         f"{p}n": inside(F.pow(fit("n_inv4"), F.lit(-0.25))),
         f"{p}tau": inside(F.pow(fit("sqrt_tau_plus") - 3.0, F.lit(2.0))),
         f"{p}ksat": inside(F.exp(fit("ln_ksat")))},
    ]


def wosten(p: str = "", van_bemmelen: float = VAN_BEMMELEN) -> Steps:
    w = f"__{p}"
    clay, om0 = F.col("__clay"), F.col("__oc") * F.lit(van_bemmelen)
    cap = F.when(clay > 60, F.lit(18.0)).when(clay <= 60, 12.0 + 0.1 * clay)
    silt, om, b, c, s, top = (F.col(n) for n in (f"{p}silt", f"{w}om", f"{w}bd", f"{w}clay", f"{w}silt", f"{w}top"))
    terms = {
        "clay": c, "silt": s, "om": om, "bd": b, "top": top,
        "clay^2": c * c, "silt^2": s * s, "om^2": om * om, "bd^2": b * b,
        "1/clay": 1.0 / c, "1/silt": 1.0 / s, "1/om": 1.0 / om, "1/bd": 1.0 / b,
        "ln silt": F.ln(s), "ln om": F.ln(om), "ln bd": F.ln(b),
        "om clay": om * c, "bd clay": b * c, "bd om": b * om, "bd silt": b * s,
        "top silt": top * s, "top clay": top * c,
    }
    capped = F.when(F.col(f"{w}om0") > F.col(f"{w}cap"), F.col(f"{w}cap")).otherwise(F.col(f"{w}om0"))
    return [
        {f"{p}silt": _silt(), f"{w}om0": om0, f"{w}cap": cap},
        {f"{w}om": clip(capped, lo=0.1), f"{w}bd": clip(F.col("__bd"), lo=0.5), f"{w}clay": clip(clay, lo=0.5),
         f"{w}silt": clip(silt, lo=0.5), f"{w}top": F.when(F.col("upper_cm") < 30, 1.0).otherwise(0.0)},
        {f"{p}ths": linear(terms, WOSTEN["ths"]), f"{p}thr": F.lit(0.0),
         f"{p}alpha": F.exp(linear(terms, WOSTEN["ln_alpha"])),
         f"{p}n": F.exp(linear(terms, WOSTEN["ln_n_minus_1"])) + 1.0},
    ]


def weynants(p: str = "") -> Steps:
    terms = {**_base(), "sand^2": F.col("__sand") * F.col("__sand")}
    return [{f"{p}ths": linear(terms, WEYNANTS["ths"]), f"{p}thr": F.col("__clay") * 0.0,
             f"{p}alpha": F.exp(linear(terms, WEYNANTS["ln_alpha"])),
             f"{p}n": F.exp(linear(terms, WEYNANTS["ln_n_minus_1"])) + 1.0}]


def puhlmann(p: str = "") -> Steps:
    silt, (sand, clay, oc, bd) = F.col(f"{p}silt"), _base().values()
    terms = {
        **_base(), "silt": silt, "sqrt oc": F.sqrt(oc), "sqrt sand": F.sqrt(sand),
        "ln(clay+1)": safe_ln(clay + 1.0), "ln(oc+0.1)": safe_ln(oc + 0.1),
        "bd^2": bd * bd, "silt^2": silt * silt, "sand^2": sand * sand, "silt bd": silt * bd,
        "silt/bd": silt / F.when(bd > 0, bd),
    }
    return [
        {f"{p}silt": _silt()},
        {f"{p}ths": nn(linear(terms, PUHLMANN["ths"])), f"{p}thr": F.lit(0.0),
         f"{p}alpha": F.exp(linear(terms, PUHLMANN["ln_alpha"])),
         f"{p}n": F.exp(linear(terms, PUHLMANN["ln_n_minus_1"])) + 1.0},
    ]


def teepe(p: str = "", awc_direct: bool = False) -> Steps:
    silt, (sand, clay, _, bd) = F.col(f"{p}silt"), _base().values()
    terms = {
        "sand": sand, "clay": clay, "silt": silt, "bd": bd, "sand^2": sand * sand, "silt^2": silt * silt,
        "sand/bd": F.try_divide(sand, bd), "silt/bd": F.try_divide(silt, bd),
        "sqrt sand": F.sqrt(sand), "sqrt silt": F.sqrt(silt),
        "ln sand": safe_ln(sand), "ln silt": safe_ln(silt),
    }
    if awc_direct:
        return [{f"{p}silt": _silt()}, {f"{p}awc_vol": linear(terms, TEEPE["awc_vol"])}]
    return [
        {f"{p}silt": _silt()},
        {f"{p}ths": linear(terms, TEEPE["ths"]), f"{p}thr": bd * 0.0,
         f"{p}alpha": nn(F.exp(linear(terms, TEEPE["ln_alpha"]))),
         f"{p}n": F.exp(linear(terms, TEEPE["ln_n_minus_1"])) + 1.0},
    ]


def toth(p: str = "") -> Steps:
    clay, silt, t = F.col("__clay"), F.col(f"{p}silt"), F.col(f"__{p}t")
    terms = {"clay": clay, "silt": silt, "t": t, "silt t": silt * t, "silt clay": silt * clay, "clay t": clay * t}
    return [
        {f"{p}silt": _silt(clipped=False), f"__{p}t": F.try_divide(F.lit(1.0), F.col("__oc") + 1.0)},
        {f"{p}fc": linear(terms, TOTH["fc"]), f"{p}wp": linear(terms, TOTH["wp"])},
        {f"{p}awc_vol": F.col(f"{p}fc") - F.col(f"{p}wp")},
    ]


def saxton_rawls(p: str = "", density_factor: float | None = None, van_bemmelen: float = VAN_BEMMELEN) -> Steps:
    if density_factor is not None and not 0.9 <= density_factor <= 1.3:
        raise ValueError(f"density_factor must lie in [0.9, 1.3], got {density_factor}")
    w = f"__{p}"
    s, c, om, a, b, d = (F.col(w + n) for n in ("s", "c", "om", "a", "b", "d"))
    terms = {"s": s, "c": c, "om": om, "s om": s * om, "c om": c * om, "s c": s * c}
    wp, fc, sat = (F.col(p + n) for n in ("wp", "fc", "sat"))
    half = clip(F.col("__sand") / 100.0 + F.col("__clay") / 100.0 - 1.0, lo=0.0) / 2.0
    # A wilting point at or above capacity, or a capacity at or above saturation, drops to 95 percent of it.
    ordered = {p + "wp": F.when(wp >= fc, fc * 0.95).otherwise(wp), p + "fc": F.when(fc >= sat, sat * 0.95).otherwise(fc)}
    steps = [
        {w + "half": half, w + "om": F.col("__oc") * F.lit(van_bemmelen) / 100.0},
        {w + "s": F.col("__sand") / 100.0 - F.col(w + "half"), w + "c": F.col("__clay") / 100.0 - F.col(w + "half")},
        {w + "a": linear(terms, SAXTON_RAWLS["wilting"]), w + "b": linear(terms, SAXTON_RAWLS["capacity"]),
         w + "d": linear(terms, SAXTON_RAWLS["drainable"])},
        # Second-stage corrections, fixed values of the same publication.
        {p + "wp": a + (0.14 * a - 0.02), p + "fc": b + (1.283 * b * b - 0.374 * b - 0.015)},
        {p + "sat": fc + (d + (0.636 * d - 0.107)) - 0.097 * s + 0.043},
        ordered,
    ]
    if density_factor is not None:
        steps += [
            {w + "dense": 1.0 - (1.0 - sat) * 2.65 * density_factor / 2.65},
            {p + "fc": fc - 0.2 * (sat - F.col(w + "dense")), p + "sat": F.col(w + "dense")},
            ordered,
        ]
    return [*steps, {p + "awc_vol": fc - wp}]


def mvg_theta(h_cm, ths: Column, thr: Column, alpha: Column, n: Column) -> Column:
    """Van Genuchten water content at suction head ``h_cm``; NULL when n <= 1."""
    shape = F.when(n > 1.0, n)
    m = 1.0 - 1.0 / shape
    drained = F.pow(1.0 + F.pow(alpha * F.lit(float(h_cm)), shape), m)
    return nn(thr + (ths - thr) / drained)


def water_between(fc: float, pwp: float, p: str = "") -> Steps:
    """fc_vol, pwp_vol and their difference from retention parameters."""
    params = [F.col(p + c) for c in RETENTION]
    return [{p + "fc_vol": mvg_theta(fc, *params), p + "pwp_vol": mvg_theta(pwp, *params)},
            {p + "awc_vol": F.col(p + "fc_vol") - F.col(p + "pwp_vol")}]


# Functions with a closed form per soil row, and whether they give retention
# parameters (True) or field capacity and wilting point (False).
CLOSED_FORM = {"schoch": (schoch, True), "wosten": (wosten, True), "weynants": (weynants, True),
               "puhlmann": (puhlmann, True), "teepe": (teepe, True), "toth": (toth, False),
               "saxton": (saxton_rawls, False)}


def awc_volume_steps(names, fc: float, pwp: float) -> Steps:
    """Steps ending in one ``<name>_awc_vol`` column per function.

    Step i of every function shares one projection, which keeps the plan short.
    """
    parts = []
    for name in names:
        make, retention = CLOSED_FORM[name]
        steps = make(f"{name}_")
        parts.append(steps + water_between(fc, pwp, f"{name}_") if retention else steps)
    merged: Steps = []
    for i in range(max(map(len, parts), default=0)):
        merged.append({n: c for steps in parts if i < len(steps) for n, c in steps[i].items()})
    return merged
