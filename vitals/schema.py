"""Schemas and dimension tables: age bands, standard weights, causes, sources, seams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

YEAR, TEXT, NUMBER = T.IntegerType(), T.StringType(), T.DoubleType()


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in columns.items()])


POPULATION = _struct(year=YEAR, area=TEXT, sex=TEXT, age_band=TEXT, pop=NUMBER, source_indicator=TEXT)
DEATHS = _struct(year=YEAR, area=TEXT, sex=TEXT, cause=TEXT, age_band=TEXT, deaths=NUMBER, source_indicator=TEXT)
BIRTHS = _struct(year=YEAR, area=TEXT, births=NUMBER, source_indicator=TEXT)
INFANT_DEATHS = _struct(year=YEAR, area=TEXT, sex=TEXT, cause=TEXT, deaths=NUMBER, source_indicator=TEXT)
LOOKUP = _struct(municipality=TEXT, municipality_code=TEXT, nuts1=TEXT, nuts2=TEXT, nuts3=TEXT, indicator=TEXT)

# The 18 age bands in order, with the European standard population of 2013.
AGE_BANDS = [
    ("0 - 4 anos", 5000), ("5 - 9 anos", 5500), ("10 - 14 anos", 5500), ("15 - 19 anos", 5500), ("20 - 24 anos", 6000), ("25 - 29 anos", 6000),
    ("30 - 34 anos", 6500), ("35 - 39 anos", 7000), ("40 - 44 anos", 7000), ("45 - 49 anos", 7000), ("50 - 54 anos", 7000), ("55 - 59 anos", 6500),
    ("60 - 64 anos", 6000), ("65 - 69 anos", 5500), ("70 - 74 anos", 5000), ("75 - 79 anos", 4000), ("80 - 84 anos", 2500), ("85 e mais anos", 2500),
]

# The last bands, which the under-75 measures leave out.
OVER_74 = ["75 - 79 anos", "80 - 84 anos", "85 e mais anos"]

# The vocabulary of the stored rows.
BOTH_SEXES, MEN, WOMEN = "HM", "H", "M"
ALL_CAUSES = "Todas as causas de morte"
ROLL_UP_BANDS = ["Total", "Idade ignorada"]
PSEUDO_AREAS = ["Total", "Ignorado", "Estrangeiro"]

# First year of a new population basis, and what it does to rates.
SEAMS = [(2014, "standardised rates move by about 3 %, crude rates by 0.2 %"), (2021, "rates fall by about 1.7 %, and more in the years after")]

# Sources by dataset and indicator; the largest priority wins.
PRIORITIES = [("population", "0012918", 3), ("population", "0003182", 2), ("population", "0008273", 1), ("deaths", "0013166", 2), ("deaths", "0008206", 1)]

# Causes that prevention avoids, that care avoids, and that the short list can't tell.
PREVENTABLE = [
    "Doenças pelo vírus da imunodeficiência humana [HIV]",
    "Tumor (neoplasma) maligno do lábio, cavidade bucal e faringe",
    "Tumor (neoplasma) maligno do esófago",
    "Tumor (neoplasma) maligno do fígado e das vias biliares intra-hepáticas",
    "Tumor (neoplasma) maligno da laringe, da traqueia, dos brônquios e dos pulmões",
    "Melanoma maligno da pele",
    "Tumor (neoplasma) maligno da bexiga",
    "Transtornos mentais e comportamentais devidos ao uso de álcool",
    "Dependência de drogas (toxicomania)",
    "Doenças crónicas das vias aéreas inferiores",
    "Doenças crónicas do fígado",
    "Acidentes de transporte",
    "Quedas acidentais",
    "Envenenamento (intoxicação) acidental por drogas, medicamentos e substâncias biológicas",
    "Suicídios e lesões autoprovocadas voluntariamente",
    "Homicídios e lesões provocadas intencionalmente por outras pessoas",
]
TREATABLE = [
    "Tuberculose",
    "Infecção meningocócica",
    "Meningites (excepto 03 - Infecção meningocócica)",
    "Tumor (neoplasma) maligno do cólon",
    "Tumor (neoplasma) maligno (neoplasma) da junção retossigmoideia, reto, ânus e canal anal",
    "Tumor (neoplasma) maligno da mama",
    "Tumor (neoplasma) maligno do colo do útero",
    "Tumor (neoplasma) maligno do rim, excepto pelve renal",
    "Diabetes mellitus",
    "Pneumonia",
    "Gripe (Influenza)",
    "Asma e estado de mal asmático",
    "Úlcera gástrica, duodenal, péptica de localização não especificada e gastrojejunal",
    "Doenças do rim e ureter",
    "Complicações da gravidez, parto e puerpério",
    "Algumas afecções originadas no período perinatal",
    "Malformações congénitas, deformidades e anomalias cromossómicas",
]
UNRESOLVED = [
    ("Doenças isquémicas do coração", "half preventable, half treatable; the short list can't split it"),
    ("Doenças cérebro-vasculares", "treatable as a whole, but part is owed to primary prevention"),
    ("Tumor (neoplasma) maligno do estômago", "in some revisions of the list only"),
    ("Tumor (neoplasma) maligno do tecido linfático e hematopoético e tecidos relacionados", "a few of the tumours it gathers are treatable"),
    ("Tumor (neoplasma) maligno do ovário", "in some revisions of the list only"),
    ("Hepatite viral", "type B is preventable, type C treatable; the short list can't split them"),
]


def age_bands(spark: SparkSession) -> DataFrame:
    """age_band, band_idx, weight, under75; 18 rows."""
    rows = [(b, k, float(w), b not in OVER_74) for k, (b, w) in enumerate(AGE_BANDS)]
    return spark.createDataFrame(rows, "age_band string, band_idx int, weight double, under75 boolean")


def cause_groups(spark: SparkSession) -> DataFrame:
    """cause, group, reason: each cause of the lists once."""
    rows = [(c, "preventable", None) for c in PREVENTABLE] + [(c, "treatable", None) for c in TREATABLE] + [(c, "unresolved", r) for c, r in UNRESOLVED]
    return spark.createDataFrame(rows, "cause string, `group` string, reason string")


def seams(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SEAMS, "seam int, effect string")


def priorities(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRIORITIES, "dataset string, source_indicator string, priority int")

#: Metrics that divide by the population.
RATE_METRICS = ["crude", "dsr", "smr", "isr"]
