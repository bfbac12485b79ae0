"""Small files as rows: worker profiles with their hashes and drift, JSON-lines corpora, SQL assets, settings of the environment."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_PROFILE = 64 << 10
#: Fixed value: the members of a guard corpus.
CORPUS = "id string, class string, locale string, surface string, input string, expected_decision string, expected_rules array<string>"


def profile_files(spark: SparkSession, path: str, most: int = MAX_PROFILE) -> DataFrame:
    """(path, hash, doc, problem) of JSON profile files: the sha256 of their bytes and their text; oversize beyond `most` bytes, not_json."""
    raw = spark.read.format("binaryFile").load(path)
    fits = F.col("length") <= most
    doc = F.when(fits, F.col("content").cast("string"))
    problem = F.when(~fits, "oversize").when(F.json_object_keys(doc).isNull(), "not_json")
    return raw.select("path", F.when(fits, F.sha2("content", 256)).alias("hash"), F.when(problem.isNull(), doc).alias("doc"), problem.alias("problem"))


def profile_drift(loaded: DataFrame, current: DataFrame) -> DataFrame:
    """(path, match, error) of loaded profiles (path, hash) against their files now: error is missing or what is wrong with the file."""
    now = current.select(F.col("path").alias("_path"), F.col("hash").alias("_hash"), F.col("problem").alias("_problem"))
    both = loaded.join(now, F.col("path") == F.col("_path"), "left")
    error = F.when(F.col("_path").isNull(), "missing").otherwise(F.col("_problem"))
    return both.select("path", F.coalesce(F.col("hash") == F.col("_hash"), F.lit(False)).alias("match"), error.alias("error"))


def corpus(spark: SparkSession, path: str, schema: str = CORPUS) -> DataFrame:
    """Rows of a JSON-lines corpus, with malformed lines as they are in _broken."""
    return spark.read.schema(f"{schema}, _broken string").option("columnNameOfCorruptRecord", "_broken").json(path)


def sql_assets(folder: str) -> dict[str, str]:
    """Trimmed text of a folder's .sql files by name; an empty one is an error."""
    found = {p.stem: p.read_text(encoding="utf-8").strip() for p in sorted(Path(folder).glob("*.sql"))}
    if blank := [k for k, v in found.items() if not v]:
        raise ValueError(f"empty SQL assets: {blank}")
    return found


def compose(template: str, **fragments: str) -> str:
    """A template with each {{name}} replaced by the fragment of that name; one without a fragment is an error."""
    for name, text in fragments.items():
        template = template.replace("{{" + name + "}}", text)
    if "{{" in template:
        raise ValueError(f"fragment missing: {template[template.index('{{') :][:40]}")
    return template


def setting(env: dict[str, str], key: str) -> str | None:
    """A setting from KEY or from the file that KEY_FILE names, without its last line end; both at once is an error."""
    plain, file = env.get(key), env.get(f"{key}_FILE")
    if plain and file:
        raise ValueError(f"both {key} and {key}_FILE are set")
    if file:
        return Path(file).read_text(encoding="utf-8").rstrip("\r\n")
    return plain


def dotenv(text: str) -> dict[str, str]:
    """KEY=value lines: blank lines and # comments don't count, export and quotes go, a name that isn't one is an error."""
    out: dict[str, str] = {}
    for number, line in enumerate(text.splitlines(), 1):
        line = line.strip().removeprefix("export ").strip()
        if not line or line.startswith("#"):
            continue
        name, equals, value = line.partition("=")
        name, value = name.strip(), value.strip()
        if not equals or not name.replace("_", "a").isalnum() or name[0].isdigit():
            raise ValueError(f"line {number} isn't KEY=value")
        if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"":
            value = value[1:-1]
        else:
            value = value.split(" #", 1)[0].rstrip()
        out[name] = value
    return out
