"""Pedotransfer functions written out as SQL, independent of the column code."""

PROFILE = "SELECT soil.*, upper_cm, lower_cm, thick_mm FROM soil JOIN layers ON soil.layer = layers.layer"


def theta(h: float) -> str:
    return (f"CASE WHEN n > 1 THEN thr + (ths - thr) / pow(1 + pow(alpha * {h:.1f}E0, n), 1 - 1 / n) END")


def ln(x: str) -> str:
    return f"CASE WHEN {x} > 0 THEN ln({x}) WHEN {x} = 0 THEN '-Infinity'::DOUBLE END"


def r(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0"


def log6(x: str) -> str:
    return f"round(ln(CASE WHEN {x} > 0 THEN {x} END), 6) + 0.0"


SCHOCH = f"""
SELECT * EXCLUDE (ths0, thr0, loc),
  CASE WHEN thr0 >= 0 THEN ths0 END AS ths, CASE WHEN thr0 >= 0 THEN thr0 END AS thr,
  CASE WHEN thr0 >= 0 THEN exp(-3.84E0 - 1.32E0*trd + .0237E0*clay + .0353E0*sand + .210E0*loc) END AS alpha,
  CASE WHEN thr0 >= 0 THEN pow(.240E0 + .220E0*trd + .00291E0*clay - .00305E0*sand + .0329E0*loc, -0.25E0) END AS n,
  CASE WHEN thr0 >= 0 THEN pow(2.8469E0 - .229E0*trd - .0106E0*clay - .00428E0*sand + .0685E0*loc - 3E0, 2) END AS tau,
  CASE WHEN thr0 >= 0 THEN exp(7.45E0 - 3.16E0*trd - .0364E0*clay + .0414E0*sand + .327E0*loc) END AS ksat
FROM (SELECT *, .919E0 - .355E0*trd + .000647E0*clay + .000434E0*sand - .00229E0*loc AS ths0,
        exp(-1.56E0 - .217E0*trd + .0106E0*clay + .0049E0*sand) - .2E0 AS thr0
      FROM (SELECT *, {ln('soc')} AS loc FROM profile))
"""

WOSTEN = """
SELECT row, col, layer, upper_cm, lower_cm, thick_mm, gravel, silt,
  .7919E0 + .001691E0*cl - .29619E0*bd - 1.491E-6*sl*sl + 8.21E-5*om*om + .02427E0/cl + .01113E0/sl + .01472E0*ln(sl)
    - 7.33E-5*om*cl - .000619E0*bd*cl - .001183E0*bd*om - 1.664E-4*top*sl AS ths,
  0E0 AS thr,
  exp(-14.96E0 + .03135E0*cl + .0351E0*sl + .646E0*om + 15.29E0*bd - .192E0*top - 4.671E0*bd*bd - .000781E0*cl*cl
    - .00687E0*om*om + .0449E0/om + .0663E0*ln(sl) + .1482E0*ln(om) - .04546E0*bd*sl - .4852E0*bd*om
    + .00673E0*top*cl) AS alpha,
  1E0 + exp(-25.23E0 - .02195E0*cl + .0074E0*sl - .1940E0*om + 45.5E0*bd - 7.24E0*bd*bd + 3.658E-4*cl*cl
    + .002885E0*om*om - 12.81E0/bd - .1524E0/sl - .01958E0/om - .2876E0*ln(sl) - .0709E0*ln(om) - 44.6E0*ln(bd)
    - .02264E0*bd*cl + .0896E0*bd*om + .00718E0*top*cl) AS n
FROM (SELECT *, greatest(om1, .1E0) AS om, greatest(trd, .5E0) AS bd, greatest(clay, .5E0) AS cl,
             greatest(silt, .5E0) AS sl
      FROM (SELECT *, least(greatest(100E0 - sand - clay, 0E0), 100E0) AS silt,
                   CASE WHEN upper_cm < 30 THEN 1E0 ELSE 0E0 END AS top,
                   CASE WHEN clay > 60 THEN least(1.72E0*soc, 18E0)
                        ELSE least(1.72E0*soc, 12E0 + .1E0*clay) END AS om1
            FROM profile))
"""

WEYNANTS = """
SELECT *, .6355E0 + .0013E0*clay - .1631E0*trd AS ths, clay*0E0 AS thr,
  exp(-4.3003E0 - .0097E0*clay + .0138E0*sand - .0992E0*soc) AS alpha,
  1E0 + exp(-1.0846E0 - .0236E0*clay - .0085E0*sand + .0001E0*sand*sand) AS n
FROM profile
"""

PUHLMANN = """
SELECT *, .015362E0*sqrt(soc) - .2513E0*trd - .026836E0*ln(clay + 1) - .0055404E0*sqrt(sand) + .8648E0 AS ths, 0E0 AS thr,
  exp(-1.187E0*trd*trd - .031899E0*sand - .58805E0*ln(soc + .1E0) - .00032963E0*silt*silt - .016267E0*silt*trd + 2.021E0) AS alpha,
  1E0 + exp(.0003758E0*sand*sand + .004751E0*silt + .017826E0*silt/trd - 2.9804E0) AS n
FROM (SELECT *, least(greatest(100E0 - sand - clay, 0E0), 100E0) AS silt FROM profile)
"""

TEEPE = f"""
SELECT *, .9786E0 - .36686E0*trd AS ths, trd*0E0 AS thr,
  exp(55.576E0 - 4.433E0*trd - .002E0*silt*silt - .470E0*clay - .066E0*sand/trd - 3.683E0*sqrt(sand) - .0359E0*silt/trd
      - .0016E0*sand*sand - 3.6916E0*sqrt(silt) + 1.8643E0*({ln('sand')}) + 1.575E0*({ln('silt')})) AS alpha,
  1E0 + exp(-2.8497E0 + .00027395E0*sand*sand + .01637E0*silt) AS n,
  .4172514E0 + .1641025E0*trd - .0012394E0*clay + .00061115E0*silt AS awc_direct
FROM (SELECT *, least(greatest(100E0 - sand - clay, 0E0), 100E0) AS silt FROM profile)
"""

TOTH = """
SELECT *, fc - wp AS awc_vol FROM (
  SELECT *, .2449E0 - .1887E0*t + .004527E0*clay + .001535E0*silt + .001442E0*silt*t - .0000511E0*silt*clay + .0008676E0*clay*t AS fc,
    .09878E0 + .002127E0*clay - .0008366E0*silt - .0767E0*t + .00003853E0*silt*clay + .00233E0*clay*t + .0009498E0*silt*t AS wp
  FROM (SELECT *, 100E0 - sand - clay AS silt, 1E0/(soc + 1E0) AS t FROM profile))
"""


def saxton(density: float | None = None) -> str:
    """wp, fc, sat; the last step re-applies the ordering after a density factor."""
    base = """
SELECT *, a + (.14E0*a - .02E0) AS wp0, b + (1.283E0*b*b - .374E0*b - .015E0) AS fc0,
       b + (1.283E0*b*b - .374E0*b - .015E0) + d + (.636E0*d - .107E0) - .097E0*s + .043E0 AS sat0
FROM (SELECT *, -.024E0*s + .487E0*c + .006E0*om + .005E0*s*om - .013E0*c*om + .068E0*s*c + .031E0 AS a,
        -.251E0*s + .195E0*c + .011E0*om + .006E0*s*om - .027E0*c*om + .452E0*s*c + .299E0 AS b,
        .278E0*s + .034E0*c + .022E0*om - .018E0*s*om - .027E0*c*om - .584E0*s*c + .078E0 AS d
      FROM (SELECT *, sand/100 - e/2 AS s, clay/100 - e/2 AS c, 1.72E0*soc/100 AS om
            FROM (SELECT *, greatest(sand/100 + clay/100 - 1, 0E0) AS e FROM profile)))"""
    one = f"""
SELECT *, CASE WHEN wp0 >= fc0 THEN .95E0*fc0 ELSE wp0 END AS wp1,
       CASE WHEN fc0 >= sat0 THEN .95E0*sat0 ELSE fc0 END AS fc1 FROM ({base})"""
    if density is None:
        return f"SELECT *, wp1 AS wp, fc1 AS fc, sat0 AS sat, fc1 - wp1 AS awc_vol FROM ({one})"
    two = f"SELECT *, 1E0 - (1E0 - sat0)*{density}E0 AS sat FROM ({one})"
    three = f"SELECT *, fc1 - .2E0*(sat0 - sat) AS fc2 FROM ({two})"
    four = f"""
SELECT *, CASE WHEN wp1 >= fc2 THEN .95E0*fc2 ELSE wp1 END AS wp,
       CASE WHEN fc2 >= sat THEN .95E0*sat ELSE fc2 END AS fc FROM ({three})"""
    return f"SELECT *, fc - wp AS awc_vol FROM ({four})"


KA5_CASE = """
CASE WHEN clay >= 45 AND clay < 65 AND silt >= 15 AND silt < 30 THEN 31
     WHEN clay >= 25 AND clay < 45 AND silt >= 15 AND silt < 30 THEN 30
     WHEN clay >= 17 AND clay < 25 AND silt >= 15 AND silt < 30 THEN 29
     WHEN clay >= 17 AND clay < 25 AND silt >= 30 AND silt < 40 THEN 28
     WHEN clay >= 12 AND clay < 17 AND silt >= 10 AND silt < 40 THEN 27
     WHEN clay >= 8 AND clay < 12 AND silt >= 10 AND silt < 40 THEN 26
     WHEN clay >= 5 AND clay < 8 AND silt >= 10 AND silt < 25 THEN 25
     WHEN clay >= 35 AND clay < 45 AND silt >= 30 AND silt < 50 THEN 24
     WHEN clay >= 25 AND clay < 35 AND silt >= 30 AND silt < 50 THEN 23
     WHEN clay >= 17 AND clay < 25 AND silt >= 40 AND silt < 50 THEN 22
     WHEN clay >= 8 AND clay < 17 AND silt >= 40 AND silt < 50 THEN 21
     WHEN clay >= 30 AND clay < 45 AND silt >= 50 AND silt < 65 THEN 20
     WHEN clay >= 17 AND clay < 30 AND silt >= 50 AND silt < 65 THEN 19
     WHEN clay >= 8 AND clay < 17 AND silt >= 50 AND silt < 65 THEN 18
     WHEN clay < 8 AND silt >= 50 AND silt < 80 THEN 17
     WHEN clay < 8 AND silt >= 40 AND silt < 50 THEN 16
     WHEN clay < 8 AND silt >= 25 AND silt < 40 THEN 15
     WHEN clay < 5 AND silt >= 10 AND silt < 25 THEN 14
     WHEN clay >= 5 AND clay < 17 AND silt < 10 THEN 13
     WHEN clay >= 17 AND clay < 25 AND silt < 15 THEN 12
     WHEN clay >= 25 AND clay < 35 AND silt < 15 THEN 11
     WHEN clay >= 35 AND clay < 45 AND silt < 15 THEN 10
     WHEN clay >= 45 AND clay < 65 AND silt < 15 THEN 9
     WHEN clay >= 45 AND clay < 65 AND silt >= 30 THEN 8
     WHEN clay >= 17 AND clay < 25 AND silt >= 65 THEN 7
     WHEN clay >= 12 AND clay < 17 AND silt >= 65 THEN 6
     WHEN clay >= 8 AND clay < 12 AND silt >= 65 THEN 5
     WHEN clay >= 25 AND silt >= 65 THEN 4
     WHEN clay < 8 AND silt >= 80 THEN 3
     WHEN clay < 5 AND silt < 10 THEN 2
     WHEN clay >= 65 THEN 1 ELSE 0 END"""

KA5 = f"SELECT *, CAST({KA5_CASE} AS SMALLINT) AS ka5 FROM (SELECT *, 100E0 - sand - clay AS silt FROM profile)"

LUT = """
SELECT * FROM (VALUES (1,0,.5238E0,.06612E0,1.05215E0),(2,0,.3879E0,.26437E0,1.35154E0),(3,0,.403E0,.0142E0,1.21344E0),
 (4,.017E0,.4372E0,.04538E0,1.12039E0),(5,.0101E0,.4001E0,.01868E0,1.22068E0),(6,.0053E0,.4031E0,.01679E0,1.20668E0),
 (7,.0276E0,.4162E0,.01697E0,1.20483E0),(8,0,.4971E0,.07242E0,1.06062E0),(9,0,.4836E0,.08402E0,1.07669E0),
 (10,.07841E0,.4374E0,.06194E0,1.14565E0),(11,0,.4355E0,.20919E0,1.11419E0),(12,0,.4214E0,.18023E0,1.1323E0),
 (13,0,.4049E0,.48458E0,1.18828E0),(14,0,.3786E0,.20387E0,1.23473E0),(15,0,.3765E0,.08862E0,1.21398E0),
 (16,0,.3839E0,.06005E0,1.22228E0),(17,0,.3946E0,.02747E0,1.22393E0),(18,0,.4003E0,.02513E0,1.19338E0),
 (19,.0534E0,.4284E0,.04321E0,1.16518E0),(20,0,.4589E0,.055E0,1.08166E0),(21,0,.4138E0,.08165E0,1.17695E0),
 (22,.1406E0,.4148E0,.04052E0,1.32416E0),(23,.1492E0,.438E0,.07013E0,1.24572E0),(24,.1629E0,.453E0,.04947E0,1.17003E0),
 (25,0,.3949E0,.11647E0,1.25425E0),(26,.0519E0,.3952E0,.07097E0,1.35096E0),(27,0,.4101E0,.10486E0,1.18427E0),
 (28,.07284E0,.4091E0,.06835E0,1.20501E0),(29,.0463E0,.4129E0,.09955E0,1.18213E0),(30,.1154E0,.4325E0,.03401E0,1.19442E0),
 (31,0,.4931E0,.07339E0,1.06254E0)) AS t(ka5, thr, ths, alpha, n)
"""
