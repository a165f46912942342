"""Named sets of regions.  Larger sets come as tables (region, kind, n0, n1, n2) with a set column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.regions import Admin, Statistical

#: Names and members of region sets.
SETS: dict[str, list[tuple[str, Admin | Statistical | tuple]]] = {
    "scand3": [("SWE", Admin((), ("Sweden",))), ("NOR", Admin((), ("Norway",))), ("FIN", Admin((), ("Finland", "Åland")))],
    "denmark5": [(n, Admin(("Denmark",), (n,))) for n in ("Hovedstaden", "Midtjylland", "Nordjylland", "Sjælland", "Syddanmark")],
    "NUTS_Europe": [
        ("EU12", Statistical(("BE", "DK", "FR", "DE", "EL", "IE", "IT", "LU", "NL", "PT", "ES", "UK"))),
        ("EU15", Statistical(("AT", "FI", "SE"))),
        ("EFTA", Statistical(("IS", "LI", "NO", "CH"))),
        ("EU25", Statistical(("CY", "CZ", "EE", "HU", "LV", "LT", "MT", "PL", "SK", "SI"))),
        ("EU28", Statistical(("BG", "RO", "HR"))),
        ("CAND", Statistical(("ME", "MK", "AL", "RS", "TR", "BA", "XK"))),
    ],
    "usa9": [
        ("New England", Admin(("United States",), ("Connecticut", "Maine", "Massachusetts", "New Hampshire", "Rhode Island", "Vermont"))),
        ("Mid-Atlantic", Admin(("United States",), ("New Jersey", "New York", "Pennsylvania"))),
        ("Central NE", Admin(("United States",), ("Illinois", "Indiana", "Michigan", "Ohio", "Wisconsin"))),
        ("Central NW", Admin(("United States",), ("Iowa", "Kansas", "Minnesota", "Missouri", "Nebraska", "North Dakota", "South Dakota"))),
        ("South Atlantic", Admin(("United States",), ("Delaware", "Florida", "Georgia", "Maryland", "North Carolina", "South Carolina", "Virginia", "District of Columbia", "West Virginia"))),
        ("Central SE", Admin(("United States",), ("Alabama", "Kentucky", "Mississippi", "Tennessee"))),
        ("Central SW", Admin(("United States",), ("Arkansas", "Louisiana", "Oklahoma", "Texas"))),
        ("Mountain", Admin(("United States",), ("Arizona", "Colorado", "Idaho", "Montana", "Nevada", "New Mexico", "Utah", "Wyoming"))),
        ("Pacific", Admin(("United States",), ("California", "Oregon", "Washington"))),
    ],
    "caspian": [
        ("RU_SW", Admin(("Russia",), ("Astrakhan'", "Kalmyk", "Dagestan"))),
        ("KZK", Admin(("Kazakhstan",), ("Atyrau", "Mangghystau"))),
        ("AZR", Admin((), ("Azerbaijan",))),
        ("IRN", Admin(("Iran",), ("Gilan", "Golestan", "Mazandaran"))),
        ("TRK", Admin(("Turkmenistan",), ("Balkan",))),
    ],
    "testreg": [("NO", Admin((), ("Norway",))), ("DK", Statistical(("DK",))), ("ISL", (Statistical(("SE214",)), Admin((), ("Åland",)), Admin(("Sweden", "Kalmar"), ("Borgholm", "Mörbylånga"))))],
}
SETS["scand4"] = [*SETS["scand3"], ("DEN", Admin((), ("Denmark",)))]
SETS["scand4_ehub500"] = [*SETS["scand3"], ("DEN", Admin(("Denmark",), ("Hovedstaden", "Sjælland")))]

#: Sets of whole countries, a region a line: its name, then its members.
COUNTRIES = {
    "europe8": """
NOR: Sweden, Norway, Denmark, Finland, Åland, Faroe Islands
FRA: France, Monaco
GER: Germany, Netherlands, Belgium, Luxembourg
UK: United Kingdom, Ireland, Guernsey, Isle of Man, Jersey
MED: Greece, Bulgaria, Italy, San Marino, Vatican City, Slovenia, Croatia, Bosnia and Herzegovina, Serbia, Montenegro, Kosovo, Albania, Macedonia, Malta
BAL: Poland, Estonia, Latvia, Lithuania
SPA: Spain, Portugal, Andorra, Gibraltar
CEN: Austria, Switzerland, Czech Republic, Hungary, Slovakia, Romania, Liechtenstein
""",
    "europe13": """
SWE: Sweden
NOR: Norway
DEN: Denmark, Faroe Islands
FIN: Finland, Åland
BNL: Netherlands, Belgium, Luxembourg
GER: Germany
FRA: France, Monaco
UK: United Kingdom, Ireland, Guernsey, Isle of Man, Jersey
ITA: Italy, San Marino, Vatican City
BKN: Greece, Bulgaria, Romania, Slovenia, Croatia, Bosnia and Herzegovina, Serbia, Montenegro, Kosovo, Albania, Macedonia, Malta, Moldova
BTC: Poland, Estonia, Latvia, Lithuania
SPA: Spain, Portugal, Andorra, Gibraltar
CEN: Austria, Switzerland, Czech Republic, Hungary, Slovakia, Liechtenstein
""",
    "non_NUTS_Europe": """
mainland: Monaco, Andorra, San Marino, Vatican City
islands: Faroe Islands, Isle of Man, Guernsey, Jersey, Svalbard and Jan Mayen
east: Moldova, Ukraine, Belarus, Russia
south: Morocco, Algeria, Tunisia, Libya, Egypt, Israel, Jordan, Lebanon, Syria
west: Greenland
""",
}
#: Countries with training data for the demand model, each a region.
SYNTHETIC_DEMAND = """Argentina, Australia, Austria, Belgium, Bosnia and Herzegovina, Brazil, Bulgaria, Canada, Chile,
Croatia, Cyprus, Czech Republic, Denmark, Estonia, Finland, France, Germany, Greece, Hungary,
Iceland, Ireland, Italy, Kenya, Latvia, Lithuania, Macedonia, Mexico, Netherlands, New Zealand,
Norway, Poland, Portugal, Romania, Saudi Arabia, Serbia, Slovakia, Slovenia, South Korea, Spain,
Sri Lanka, Sweden, Switzerland, Turkey, United Kingdom"""
#: Provinces of China, a region a line.
CHINA = """
CH_N: Beijing, Tianjin, Hebei, Shanxi, Nei Mongol
CH_NE: Liaoning, Jilin, Heilongjiang
CH_E: Shanghai, Jiangsu, Zhejiang, Anhui, Fujian, Jiangxi, Shandong
CH_SC: Henan, Hubei, Hunan, Guangdong, Guangxi, Hainan
CH_SW: Chongqing, Sichuan, Guizhou, Yunnan, Xizang
CH_NW: Shaanxi, Gansu, Qinghai, Ningxia Hui, Xinjiang Uygur
"""


def lines(text: str, *parents: str) -> list[tuple[str, Admin]]:
    """Regions written a line each."""
    cut = [line.split(": ") for line in text.strip().splitlines()]
    return [(name, Admin(parents, tuple(members.split(", ")))) for name, members in cut]


SETS |= {name: lines(text) for name, text in COUNTRIES.items()}
SETS["Europe8"] = SETS["europe8"]  # the name that options use
SETS["syntheticdemandregions"] = [(n, Admin((), (n,))) for n in SYNTHETIC_DEMAND.replace(",\n", ", ").split(", ")]
SETS["Europe_background"] = [*SETS["NUTS_Europe"], *SETS["non_NUTS_Europe"]]
#: Places that go with provinces of China.
BESIDES = {"CH_E": ("Taiwan",), "CH_SC": ("Hong Kong", "Macao")}
SETS["china6"] = [(n, (d, Admin((), BESIDES[n])) if n in BESIDES else d) for n, d in lines(CHINA, "China")]
SETS["mapregions"] = [("FRA", Admin((), ("France", "Monaco"))), ("KZK", Admin((), ("Kazakhstan",))), *(x for x in SETS["china6"] if x[0] == "CH_E")]


def from_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Definitions of a set kept as a CSV table: set, region, name, kind, n0, n1, n2, ord."""
    rows = spark.read.csv(path, header=True, schema="set string, region int, name string, kind string, n0 string, n1 string, n2 string, ord int")
    return rows.where(F.col("set") == name).drop("set")


def chosen(defs: DataFrame, rows: list[int]) -> DataFrame:
    """Some regions of a larger set, by their numbers, numbered anew in that order: as one set is cut out of another."""
    spark = defs.sparkSession
    order = spark.createDataFrame([(r, k) for k, r in enumerate(rows, 1)], "region int, new int")
    return defs.join(F.broadcast(order), "region").withColumn("region", F.col("new")).drop("new").select(defs.columns)


def each_country(places: DataFrame) -> DataFrame:
    """Every country as a region of its own, numbered by name: the global set."""
    from pyspark.sql import Window

    names = places.where("n0 <> ''").select("n0").distinct()
    k = F.row_number().over(Window.orderBy("n0"))  # a row per country of the earth
    nothing = F.lit(None).cast("string")
    return names.select(k.alias("region"), F.col("n0").alias("name"), F.lit("admin").alias("kind"), "n0", nothing.alias("n1"), nothing.alias("n2"), k.alias("ord"))


def each_subregion(places: DataFrame, country: str) -> DataFrame:
    """Every province of a country as a region of its own, numbered by name."""
    names = places.where((F.col("n0") == country) & (F.col("n1") != "")).select("n1").distinct()
    from pyspark.sql import Window

    k = F.row_number().over(Window.orderBy("n1"))
    return names.select(k.alias("region"), F.col("n1").alias("name"), F.lit("admin").alias("kind"), F.lit(country).alias("n0"), "n1", F.lit(None).cast("string").alias("n2"), k.alias("ord"))
