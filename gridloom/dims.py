"""Static dimensions: nodes, clusters, weights, limits, codes and calendars.

All of them are configuration of fixed size. The DataFrame forms at the end are
built from these literals, so their size is known and they may be broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession

# --- fixed values: weather nodes, variables, clusters and weights ------------
NODES = [
    ("cd_center", 30.67, 104.07), ("cd_west", 30.68, 103.85), ("cd_east", 30.38, 104.53),
    ("dz_main", 31.22, 107.50), ("dz_south", 30.83, 107.23), ("dz_north", 31.86, 107.79),
    ("yb_main", 28.75, 104.62), ("yb_north", 29.03, 104.58), ("yb_east", 28.90, 105.43),
    ("ls_main", 27.88, 102.26), ("ls_south", 26.66, 102.25), ("ls_west", 27.42, 101.51),
    ("gz_main", 30.00, 100.27), ("gz_north", 31.62, 100.00),
    ("ya_main", 29.98, 102.98), ("ya_west", 29.86, 102.22),
    ("pzh_main", 26.58, 101.71), ("pzh_north", 26.90, 101.55), ("pzh_east", 26.60, 102.10),
]
VARIABLES = ["temp", "rh", "precip", "cloud", "wind", "rad"]
CLUSTERS = {
    "chengdu": ["cd_center", "cd_west", "cd_east"],
    "dazhou": ["dz_main", "dz_south", "dz_north"],
    "yibin": ["yb_main", "yb_north", "yb_east"],
    "liangshan": ["ls_main", "ls_south", "ls_west"],
    "ganzi": ["gz_main", "gz_north"],
    "yaan": ["ya_main", "ya_west"],
    "panzhihua": ["pzh_main", "pzh_north", "pzh_east"],
}
REGION_WEIGHTS = {
    "temp": {"chengdu": 0.5, "dazhou": 0.2, "yibin": 0.3},
    "rh": {"chengdu": 0.5, "dazhou": 0.2, "yibin": 0.3},
    "rad": {"liangshan": 0.6, "ganzi": 0.4},
    "cloud": {"liangshan": 0.6, "ganzi": 0.4},
    "wind": {"liangshan": 0.7, "ganzi": 0.3},
    "precip": {"yaan": 0.4, "panzhihua": 0.3, "liangshan": 0.3},
}
CLUSTER_LABELS = {
    "chengdu": "成都平原", "dazhou": "川东城市群", "yibin": "川南城市群", "liangshan": "凉山",
    "ganzi": "甘孜", "yaan": "雅安", "panzhihua": "攀枝花",
}
VARIABLE_LABELS = {
    "temp": "气温(℃)", "rh": "湿度(%)", "precip": "降水(mm/h)",
    "cloud": "云量(0-1)", "wind": "100m风速(m/s)", "rad": "辐射(W/m²)",
}
BASIN_CLUSTERS = {
    "金沙江下游": ["panzhihua"],
    "雅砻江流域": ["liangshan", "panzhihua"],
    "大渡河流域": ["yaan"],
    "岷江流域": ["yaan"],
}
TEMPERATURE_REGIONS = {"成都平原": "chengdu", "川东城市群": "dazhou", "川南城市群": "yibin"}

# --- fixed values: grid channels, valid ranges, jump limits ------------------
CHANNELS = [
    "price", "load", "solar", "wind", "hydro", "renewable_total",
    "bidspace", "reserve", "nonmarket", "tieline", "load_tie",
]
VALID_RANGES = {
    "price": (-300.0, 1500.0), "load": (5000.0, 65000.0), "solar": (-10.0, 20000.0),
    "wind": (0.0, 15000.0), "hydro": (0.0, 40000.0), "renewable_total": (0.0, 30000.0),
    "bidspace": (5000.0, 65000.0), "reserve": (0.0, 20000.0), "nonmarket": (0.0, 25000.0),
    "tieline": (-55000.0, 15000.0), "load_tie": (20000.0, 120000.0),
}
JUMP_LIMITS = {"price": 500.0, "load": 5000.0, "solar": 3000.0}
CORE_WEATHER = ["temp", "rad", "precip", "cloud"]

# --- fixed values: landed feed codes and sheet headers -----------------------
PAYLOAD_CODES = {
    "generateRealtimeSpotPriceU": "price",
    "provincialLoad0": "load",
    "tieLine0": "tieline",
    "newEnergy0": "renewable_total",
    "windEnergy0": "wind",
    "solarEnergy0": "solar",
    "hydroPower0": "hydro",
    "biddingSpace0": "bidspace",
    "realtimeSystemPower": "reserve",
    "noMarket0": "nonmarket",
    "provincialLoadAndTieLine0": "load_tie",
}
BASE_SHEET_COLUMNS = {
    "出清价格(元/MWh)": "price", "省内负荷(MW)": "load", "光伏(MW)": "solar", "风电(MW)": "wind",
    "水电(MW)": "hydro", "新能源总出力(MW)": "renewable_total", "竞价空间(MW)": "bidspace",
    "系统备用(MW)": "reserve", "非市场机组(MW)": "nonmarket", "联络线(MW)": "tieline",
    "负荷联络线(MW)": "load_tie", "日期类型": "day_type",
}
DISCLOSURE_COLUMNS = {
    "四川全省现货价格（元/MWh）-实时价格": "price", "省内负荷（MW）-实时": "load",
    "联络线-实时": "tieline", "新能源（总出力）-实时": "renewable_total",
    "新能源（风电）-实时": "wind", "新能源（光伏）-实时": "solar",
    "水电（含抽蓄）总出力-实时": "hydro", "竞价空间（MW）-实时": "bidspace",
    "备用信息（MW）-系统备用": "reserve", "非市场机组出力-实时": "nonmarket",
    "省内负荷&联络线-实时": "load_tie",
}
WEATHER_HEADER_PATTERNS = [
    r"气温\(℃\)", r"降水\(mm/h\)", r"辐射\(W/m²\)", r"云量\(0-1\)",
    r"24h降水\(mm\)", r"气温24h变\(℃\)", r"HDD", r"CDD",
]

# --- fixed values: calendar --------------------------------------------------
DAY_TYPES = {"workday": "工作日", "weekend": "周末", "holiday": "节假日"}
HOLIDAYS = [(1, 1, 3), (2, 15, 22), (4, 4, 6), (5, 1, 5)]  # month, first day, last day
SPRING_FESTIVAL = date(2026, 2, 17)
SLOTS = [
    ("深夜", 0, 20), ("早峰", 20, 36), ("上午", 36, 48),
    ("午谷", 48, 68), ("晚峰", 68, 88), ("夜间", 88, 96),
]


@dataclass(frozen=True)
class SplitWindow:
    """Fixed date windows of one season, both ends inside."""

    season: str
    train: tuple[date, date]
    val: tuple[date, date]
    test: tuple[date, date]


def split_windows(year: int = 2026) -> list[SplitWindow]:
    # fixed values: month and day of the window ends
    def span(m1: int, d1: int, m2: int, d2: int) -> tuple[date, date]:
        return date(year, m1, d1), date(year, m2, d2)

    return [
        SplitWindow("dry", span(1, 2, 3, 15), span(3, 16, 4, 7), span(4, 8, 4, 30)),
        SplitWindow("wet", span(5, 1, 5, 20), span(5, 21, 5, 28), span(5, 29, 6, 6)),
    ]


def weather_keys() -> list[str]:
    """The declared `{variable}_{node}` keys of a weather map."""
    return [f"{v}_{node}" for v in VARIABLES for node, _, _ in NODES]


def node_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(NODES, "node string, lat double, lon double")


def cluster_dim(spark: SparkSession) -> DataFrame:
    rows = [(c, n) for c, nodes in CLUSTERS.items() for n in nodes]
    return spark.createDataFrame(rows, "cluster string, node string")


def weight_dim(spark: SparkSession) -> DataFrame:
    rows = [(v, c, w) for v, shares in REGION_WEIGHTS.items() for c, w in shares.items()]
    return spark.createDataFrame(rows, "variable string, cluster string, weight double")


def range_dim(spark: SparkSession, ranges: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    rows = [(c, lo, hi) for c, (lo, hi) in (ranges or VALID_RANGES).items()]
    return spark.createDataFrame(rows, "channel string, lo double, hi double")


def code_dim(spark: SparkSession, codes: dict[str, str] | None = None) -> DataFrame:
    """Series code, its channel and the code of the day-ahead series behind it."""
    rows = [(code, ch, paired_code(code)) for code, ch in (codes or PAYLOAD_CODES).items()]
    return spark.createDataFrame(rows, "code string, channel string, d1_code string")


def paired_code(code: str) -> str:
    return code[:-1] + "1" if code.endswith("0") else code + "1"
