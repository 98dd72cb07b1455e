"""German KA5 texture classes: box rules and retention parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Code, class, clay >=, clay <, silt >=, silt < (percent).
# No upper limit is written as 101 because shares never exceed 100.
BOXES = [
    (1, "Tt", 65, 101, 0, 101),
    (2, "Ss", 0, 5, 0, 10),
    (3, "Uu", 0, 8, 80, 101),
    (4, "Tu4", 25, 101, 65, 101),
    (5, "Ut2", 8, 12, 65, 101),
    (6, "Ut3", 12, 17, 65, 101),
    (7, "Ut4", 17, 25, 65, 101),
    (8, "Tu2", 45, 65, 30, 101),
    (9, "Ts2", 45, 65, 0, 15),
    (10, "Ts3", 35, 45, 0, 15),
    (11, "Ts4", 25, 35, 0, 15),
    (12, "St3", 17, 25, 0, 15),
    (13, "St2", 5, 17, 0, 10),
    (14, "Su2", 0, 5, 10, 25),
    (15, "Su3", 0, 8, 25, 40),
    (16, "Su4", 0, 8, 40, 50),
    (17, "Us", 0, 8, 50, 80),
    (18, "Uls", 8, 17, 50, 65),
    (19, "Lu", 17, 30, 50, 65),
    (20, "Tu3", 30, 45, 50, 65),
    (21, "Slu", 8, 17, 40, 50),
    (22, "Ls2", 17, 25, 40, 50),
    (23, "Lt2", 25, 35, 30, 50),
    (24, "Lt3", 35, 45, 30, 50),
    (25, "Sl2", 5, 8, 10, 25),
    (26, "Sl3", 8, 12, 10, 40),
    (27, "Sl4", 12, 17, 10, 40),
    (28, "Ls3", 17, 25, 30, 40),
    (29, "Ls4", 17, 25, 15, 30),
    (30, "Lts", 25, 45, 15, 30),
    (31, "Tl", 45, 65, 15, 30),
]

# Class, thr, ths, alpha, n, tort, ksat of the published class table.
PARAMETERS = [
    ("Ss", 0.0, 0.3879, 0.26437, 1.35154, -0.594, 512.094),
    ("Sl2", 0.0, 0.3949, 0.11647, 1.25425, 0.0, 192.852),
    ("Sl3", 0.0519, 0.3952, 0.07097, 1.35096, 0.0, 89.779),
    ("Sl4", 0.0, 0.4101, 0.10486, 1.18427, -3.236, 141.295),
    ("Slu", 0.0, 0.4138, 0.08165, 1.17695, -3.919, 109.516),
    ("St2", 0.0, 0.4049, 0.48458, 1.18828, -6.189, 420.421),
    ("St3", 0.0, 0.4214, 0.18023, 1.1323, -3.42, 305.804),
    ("Su2", 0.0, 0.3786, 0.20387, 1.23473, -3.339, 285.491),
    ("Su3", 0.0, 0.3765, 0.08862, 1.21398, -3.611, 119.904),
    ("Su4", 0.0, 0.3839, 0.06005, 1.22228, -3.738, 83.297),
    ("Ls2", 0.1406, 0.4148, 0.04052, 1.32416, -2.067, 38.43),
    ("Ls3", 0.07284, 0.4091, 0.06835, 1.20501, -3.226, 98.2),
    ("Ls4", 0.0463, 0.4129, 0.09955, 1.18213, -3.604, 169.9),
    ("Lt2", 0.1492, 0.438, 0.07013, 1.24572, -3.18, 62.531),
    ("Lt3", 0.1629, 0.453, 0.04947, 1.17003, -4.099, 44.34),
    ("Lts", 0.1154, 0.4325, 0.03401, 1.19442, 0.0, 51.979),
    ("Lu", 0.0534, 0.4284, 0.04321, 1.16518, -3.227, 82.68),
    ("Uu", 0.0, 0.403, 0.0142, 1.21344, -0.561, 33.787),
    ("Uls", 0.0, 0.4003, 0.02513, 1.19338, -4.032, 40.409),
    ("Us", 0.0, 0.3946, 0.02747, 1.22393, -2.728, 35.526),
    ("Ut2", 0.0101, 0.4001, 0.01868, 1.22068, -1.382, 29.262),
    ("Ut3", 0.0053, 0.4031, 0.01679, 1.20668, -1.198, 27.708),
    ("Ut4", 0.0276, 0.4162, 0.01697, 1.20483, -0.767, 24.633),
    ("Tt", 0.0, 0.5238, 0.06612, 1.05215, 0.0, 154.737),
    ("Tl", 0.0, 0.4931, 0.07339, 1.06254, 0.0, 172.507),
    ("Tu2", 0.0, 0.4971, 0.07242, 1.06062, 0.0, 178.7),
    ("Tu3", 0.0, 0.4589, 0.055, 1.08166, 0.0, 123.765),
    ("Tu4", 0.017, 0.4372, 0.04538, 1.12039, 0.0, 88.609),
    ("Ts2", 0.0, 0.4836, 0.08402, 1.07669, 0.0, 249.862),
    ("Ts3", 0.07841, 0.4374, 0.06194, 1.14565, 0.0, 118.038),
    ("Ts4", 0.0, 0.4355, 0.20919, 1.11419, -7.612, 322.257),
    ("fS", 0.0, 0.4095, 0.15041, 1.33576, -0.328, 285.093),
    ("fSms", 0.0, 0.4095, 0.15041, 1.33576, -0.328, 285.093),
    ("fSgs", 0.0, 0.4095, 0.15041, 1.33576, -0.328, 285.093),
    ("mS", 0.0, 0.3886, 0.26188, 1.3533, -0.579, 507.5),
    ("mSfs", 0.0, 0.3886, 0.26188, 1.3533, -0.579, 507.5),
    ("mSgs", 0.0, 0.3886, 0.26188, 1.3533, -0.579, 507.5),
    ("gS", 0.0, 0.37676, 0.22065, 1.46574, 1.3829, 872.556),
]

# Sand subclasses; no texture rule yields them, a lookup may.
SAND_SUBCLASSES = [
    (32, "fS"), (33, "fSms"), (34, "fSgs"), (35, "mS"), (36, "mSfs"), (37, "mSgs"), (38, "gS"),
]

CODE_OF = {name: code for code, name, *_ in BOXES} | {name: code for code, name in SAND_SUBCLASSES}

_OPEN = 101


def ka5_code(clay: Column, silt: Column) -> Column:
    """Class code as SMALLINT; 0 when no box holds the texture or a share is NULL.

    Later boxes take precedence, so the CASE is written last box first.  The
    open ends of a box carry no comparison, hence negative silt still counts as
    "below 10".
    """
    code = None
    for value, _, clay_lo, clay_hi, silt_lo, silt_hi in reversed(BOXES):
        tests = []
        if clay_lo > 0:
            tests.append(clay >= clay_lo)
        if clay_hi < _OPEN:
            tests.append(clay < clay_hi)
        if silt_lo > 0:
            tests.append(silt >= silt_lo)
        if silt_hi < _OPEN:
            tests.append(silt < silt_hi)
        inside = tests[0]
        for test in tests[1:]:
            inside = inside & test
        code = F.when(inside, value) if code is None else code.when(inside, value)
    return code.otherwise(0).cast("smallint")


def builtin_lookup(spark: SparkSession) -> DataFrame:
    """Built-in class parameters: ka5, texture, thr, ths, alpha, n, tort, ksat (38 rows)."""
    rows = [(CODE_OF[name], name, *map(float, values)) for name, *values in PARAMETERS]
    return spark.createDataFrame(
        rows, "ka5 smallint, texture string, thr double, ths double, alpha double, n double, tort double, ksat double"
    )


def box_cells(spark: SparkSession, step: int = 5) -> DataFrame:
    """Boxes exploded to ``step``-percent tiles, the equi-join form of the rules.

    A box limit need not fall on a tile edge, so a tile row keeps its box limits
    for an exact residual test.  Open ends reach to -1000 and 1000 percent in
    the residual test; tiles beyond 0..100 are folded into the outermost tile.
    The table has a few hundred rows whatever the data.
    """
    last = 100 // step
    tiles: dict[tuple[int, int], list[tuple]] = {}
    for code, _, clay_lo, clay_hi, silt_lo, silt_hi in BOXES:
        limits = (
            -1000.0 if clay_lo == 0 else float(clay_lo), 1000.0 if clay_hi == _OPEN else float(clay_hi),
            -1000.0 if silt_lo == 0 else float(silt_lo), 1000.0 if silt_hi == _OPEN else float(silt_hi),
        )
        for i in range(clay_lo // step, min((clay_hi - 1) // step, last) + 1):
            for j in range(silt_lo // step, min((silt_hi - 1) // step, last) + 1):
                fills_tile = (limits[0] <= i * step and limits[1] >= (i + 1) * step
                              and limits[2] <= j * step and limits[3] >= (j + 1) * step)
                if fills_tile:  # a later box wins wherever it holds
                    tiles[i, j] = []
                tiles.setdefault((i, j), []).append((i, j, code, *limits))
    rows = [row for group in tiles.values() for row in group]
    return spark.createDataFrame(
        rows,
        "clay_tile int, silt_tile int, ka5 smallint, "
        "clay_lo double, clay_hi double, silt_lo double, silt_hi double",
    )
