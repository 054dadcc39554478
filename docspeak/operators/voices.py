"""The voice catalogue and how a voice is chosen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ["key", "language_code", "language_label", "display_name", "engine", "folder", "model_filename", "config_filename", "kokoro_voice"]
# The voices, and the default of each engine and language.
VOICES = [
    ("en_US-lessac-medium", "en", "English", "English — Lessac (Piper, fast)", "piper", "en/en_US/lessac/medium", "en_US-lessac-medium.onnx", "en_US-lessac-medium.onnx.json", None),
    ("en_US-hfc_female-medium", "en", "English", "English — HFC Female (Piper, fast)", "piper", "en/en_US/hfc_female/medium", "en_US-hfc_female-medium.onnx", "en_US-hfc_female-medium.onnx.json", None),
    ("pt_BR-faber-medium", "pt-BR", "Português (Brasil)", "Português — Faber (Piper, fast)", "piper", "pt/pt_BR/faber/medium", "pt_BR-faber-medium.onnx", "pt_BR-faber-medium.onnx.json", None),
    ("pt_BR-cadu-medium", "pt-BR", "Português (Brasil)", "Português — Cadu (Piper, fast)", "piper", "pt/pt_BR/cadu/medium", "pt_BR-cadu-medium.onnx", "pt_BR-cadu-medium.onnx.json", None),
    ("kokoro-en-heart", "en", "English", "English — Heart (Kokoro, quality)", "kokoro", None, None, None, "af_heart"),
    ("kokoro-en-michael", "en", "English", "English — Michael (Kokoro, quality)", "kokoro", None, None, None, "am_michael"),
    ("kokoro-en-bella", "en", "English", "English — Bella (Kokoro, quality)", "kokoro", None, None, None, "af_bella"),
    ("kokoro-pt-dora", "pt-BR", "Português (Brasil)", "Português — Dora (Kokoro, quality)", "kokoro", None, None, None, "pf_dora"),
]
DEFAULTS = {("piper", "en"): "en_US-lessac-medium", ("piper", "pt"): "pt_BR-faber-medium", ("kokoro", "en"): "kokoro-en-heart", ("kokoro", "pt"): "kokoro-pt-dora"}
# End of fixed values.


def voices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(VOICES, ", ".join(f"{c} string" for c in COLUMNS))


def for_ui(spark: SparkSession) -> DataFrame:
    return voices(spark).select(*COLUMNS[:5])


def engine_name(engine: Column) -> Column:
    return F.when(engine.isin("piper", "kokoro"), engine).otherwise(F.lit("piper"))


def resolve(requested: Column, language: Column, engine: Column) -> Column:
    """A known voice that was asked for wins, whatever its engine; else the default of the language, English if unknown."""
    is_pt = F.lower(F.trim(F.coalesce(language, F.lit("")))).startswith("pt")
    quality = engine.eqNullSafe(F.lit("kokoro"))
    default = F.when(quality & is_pt, F.lit(DEFAULTS["kokoro", "pt"])).when(quality, F.lit(DEFAULTS["kokoro", "en"])).when(is_pt, F.lit(DEFAULTS["piper", "pt"])).otherwise(F.lit(DEFAULTS["piper", "en"]))
    return F.when(requested.isin([v[0] for v in VOICES]), requested).otherwise(default)


def compatible(key: Column, engine: Column) -> Column:
    """Automatic and unknown voices fit every engine."""
    own = F.when(F.lit(False), F.lit(""))
    for v in VOICES:
        own = own.when(key == v[0], F.lit(v[4]))
    return F.coalesce(own == engine, F.lit(True))


def for_choice(spark: SparkSession, language: str, engine: str | None) -> DataFrame:
    """The voices offered for a language (``auto`` or one that isn't known: any) and an engine (none: any)."""
    code = F.lower("language_code")
    fits = code.startswith(language[:2].lower()) if language in ("pt-BR", "en") else F.lit(True)
    return for_ui(spark).where(fits & (F.col("engine") == engine if engine else F.lit(True)))


def _field(key: Column, name: str) -> Column:
    pairs = [(v[0], v[COLUMNS.index(name)]) for v in VOICES]
    return F.try_element_at(F.create_map(*(F.lit(x) for p in pairs for x in p)), key)


def engine_of(key: Column) -> Column:
    return _field(key, "engine")


def record(key: Column) -> Column:
    """What is written of a voice."""
    return F.struct(key.alias("key"), *(_field(key, c).alias(c) for c in ("display_name", "language_code", "engine")))


def kokoro_name(key: Column) -> Column:
    """The engine's own name of a voice; its default of the language for one that has none."""
    default = F.when(F.lower(_field(key, "language_code")).startswith("pt"), F.lit("pf_dora")).otherwise(F.lit("af_heart"))
    return F.coalesce(_field(key, "kokoro_voice"), default)


def addresses(spark: SparkSession, base: str, folder: str) -> DataFrame:
    """``key`` and, for voices that are files, where their model and configuration come from and are kept."""
    rows = voices(spark).where(F.col("model_filename").isNotNull())
    names = {"model": "model_filename", "config": "config_filename"}
    return rows.select("key", *(F.concat_ws("/", F.lit(base.rstrip("/")), "folder", c).alias(f"{k}_url") for k, c in names.items()), *(F.concat_ws("/", F.lit(folder.rstrip("/")), c).alias(f"{k}_path") for k, c in names.items()))


def model_path(folder: Column, name: Column) -> Column:
    return F.concat_ws("/", folder, name)


def kokoro_language(code: Column) -> Column:
    return F.when(F.lower(code).startswith("pt"), F.lit("p")).otherwise(F.lit("a"))
