"""Scalar functions of event studies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Industry code ranges of the 12-industry classification; the first match wins, others are "Other".
FF12 = (
    ("NoDur", ((100, 999), (2000, 2399), (2700, 2749), (2770, 2799), (3100, 3199), (3940, 3989))),
    ("Durbl", ((2500, 2519), (2590, 2599), (3630, 3659), (3710, 3711), (3714, 3714), (3716, 3716), (3750, 3751), (3792, 3792), (3900, 3939), (3990, 3999))),
    ("Manuf", ((2520, 2589), (2600, 2699), (2750, 2769), (3000, 3099), (3200, 3569), (3580, 3629), (3700, 3709), (3712, 3713), (3715, 3715), (3717, 3749), (3752, 3791), (3793, 3799), (3830, 3839), (3860, 3899))),
    ("Enrgy", ((1200, 1399), (2900, 2999))),
    ("Chems", ((2800, 2829), (2840, 2899))),
    ("BusEq", ((3570, 3579), (3660, 3692), (3694, 3699), (3810, 3829), (7370, 7379))),
    ("Telcm", ((4800, 4899),)),
    ("Utils", ((4900, 4949),)),
    ("Shops", ((5000, 5999), (7200, 7299), (7600, 7699))),
    ("Hlth", ((2830, 2839), (3693, 3693), (3840, 3859), (8000, 8099))),
    ("Money", ((6000, 6999),)),
)

# Industry code ranges of the 48-industry classification, as far as it is mapped; ranges overlap, the first match wins, others are "Other".
FF48 = (
    ("Agric", ((100, 299), (700, 799), (910, 919), (2048, 2048))),
    ("Food", ((2000, 2046), (2050, 2063), (2070, 2079), (2090, 2095), (2098, 2099))),
    ("Soda", ((2064, 2068), (2086, 2087), (2096, 2097))),
    ("Beer", ((2080, 2085),)),
    ("Smoke", ((2100, 2199),)),
    ("Toys", ((920, 999), (3650, 3652), (3732, 3732), (3930, 3949))),
    ("Books", ((2700, 2749), (2770, 2771), (2780, 2799))),
    ("Hshld", ((2840, 2844), (3160, 3199), (3260, 3260), (3630, 3639), (3910, 3919))),
    ("Clths", ((2300, 2390), (3020, 3021), (3100, 3111), (3130, 3159), (3965, 3965))),
    ("Hlth", ((8000, 8099),)),
    ("MedEq", ((3693, 3693), (3840, 3851))),
    ("Drugs", ((2830, 2836),)),
    ("Chems", ((2800, 2829), (2850, 2899))),
    ("Rubbr", ((3000, 3099),)),
    ("Txtls", ((2200, 2284), (2290, 2295), (2297, 2299))),
    ("BldMt", ((2400, 2459), (2490, 2499), (3200, 3259), (3261, 3299))),
    ("Cnstr", ((1500, 1799),)),
    ("Steel", ((3300, 3369), (3390, 3399))),
    ("Mach", ((3510, 3536), (3540, 3569), (3580, 3599))),
    ("ElcEq", ((3600, 3621), (3623, 3629), (3640, 3646), (3648, 3649), (3660, 3699))),
    ("Autos", ((3710, 3711), (3713, 3716), (3792, 3792), (3790, 3791), (3799, 3799))),
    ("Aero", ((3720, 3729),)),
    ("Ships", ((3730, 3731),)),
    ("Mines", ((1000, 1119), (1400, 1499))),
    ("Coal", ((1200, 1299),)),
    ("Oil", ((1300, 1399), (2900, 2912), (2990, 2999))),
    ("Util", ((4900, 4961),)),
    ("Telcm", ((4800, 4899),)),
    ("PerSv", ((7020, 7021), (7200, 7299), (7395, 7395), (7500, 7549))),
    ("BusSv", ((7300, 7372), (7374, 7385), (7389, 7394), (7397, 7397))),
    ("Comps", ((3570, 3579), (3680, 3689), (3695, 3695), (7373, 7373))),
    ("Chips", ((3622, 3622), (3660, 3679), (3810, 3829))),
    ("LabEq", ((3811, 3827), (3829, 3829))),
    ("Boxes", ((2440, 2449), (2640, 2659), (3220, 3221), (3410, 3412))),
    ("Trans", ((4000, 4013), (4040, 4049), (4100, 4173), (4190, 4299), (4400, 4789))),
    ("Whlsl", ((5000, 5199),)),
    ("Rtail", ((5200, 5999),)),
    ("Meals", ((5800, 5899), (7000, 7019))),
    ("Banks", ((6000, 6199),)),
    ("Insur", ((6300, 6411),)),
    ("RlEst", ((6500, 6611),)),
    ("Fin", ((6200, 6299), (6700, 6799))),
)


def intervals(classes) -> list[tuple[int, int, str]]:
    """Disjoint (low, high, label) of ordered classes whose ranges overlap: all ends cut the codes into pieces, each of which
    has the label of the first class that holds it."""
    spans = [(low, high, place, label) for place, (label, ranges) in enumerate(classes) for low, high in ranges]
    cuts = sorted({x for low, high, *_ in spans for x in (low, high + 1)})
    out = []
    for low, end in zip(cuts, cuts[1:]):
        holding = [(place, label) for a, b, place, label in spans if a <= low and end - 1 <= b]
        if holding:
            out.append((low, end - 1, min(holding)[1]))
    return out


def with_industry(rows: DataFrame, sic: str, name: str, classes=FF48) -> DataFrame:
    """The rows with their code's label: "Other" outside all classes, null without a numeric code. The pieces become one row
    a code, ten thousand at most, so that each row is one lookup."""
    code = F.col(sic).cast("string").try_cast("double").cast("int")
    pieces = rows.sparkSession.createDataFrame(intervals(classes), "low int, high int, label string")
    codes = pieces.select(F.explode(F.sequence("low", "high")).alias("__code"), F.col("label").alias("__label"))
    found = rows.withColumn("__sic", code).join(F.broadcast(codes), F.col("__sic") == F.col("__code"), "left")
    return found.withColumn(name, F.when(F.col("__sic").isNotNull(), F.coalesce("__label", F.lit("Other")))).drop("__sic", "__code", "__label")


def hour_of(times: Column) -> Column:
    """Text before the first colon as a number; null if it is none."""
    return F.split_part(times, F.lit(":"), F.lit(1)).try_cast("int")


def anchor_date(dates: Column, times: Column) -> Column:
    """The day after for announcements at 16 h or later, or at an unknown time."""
    hour = hour_of(times)
    return F.when(hour.isNull() | (hour >= 16), F.date_add(dates, 1)).otherwise(dates)


def quarter_label(dates: Column) -> Column:
    return F.concat(F.year(dates), F.lit("Q"), F.quarter(dates))


def approx_close(dates: Column, horizon: int) -> Column:
    """Calendar day by which a window of trading days has closed, about."""
    return F.date_add(dates, round(horizon * 7 / 5))


def normalised(names: Column) -> Column:
    return F.regexp_replace(F.upper(names), "[^A-Z0-9]", "")


def company_key(keys: Column) -> Column:
    """Text before a point, padded with zeros to six places, longer ones as they are."""
    head = F.split_part(keys, F.lit("."), F.lit(1))
    return F.when(F.length(head) < 6, F.lpad(head, 6, "0")).otherwise(head)


def safe_log(x: Column) -> Column:
    return F.when((x > 0) & (x < float("inf")), F.log(x))


def ff12(sic: Column) -> Column:
    out = F.when(sic.isNull(), F.lit(None).cast("string"))
    for label, ranges in FF12:
        hit = F.lit(False)
        for a, b in ranges:
            hit = hit | sic.between(a, b)
        out = out.when(hit, label)
    return out.otherwise("Other")


def pinball(y: Column, prediction: Column, alpha: Column | float) -> Column:
    d = y - prediction
    return F.greatest(alpha * d, (alpha - 1) * d)


def non_crossing(*quantiles: str) -> list[Column]:
    """Quantile predictions of a row in ascending order, under the same names."""
    ordered = F.sort_array(F.array(*quantiles))
    return [F.element_at(ordered, i + 1).alias(q) for i, q in enumerate(quantiles)]
