"""Review responses (JSON text, perhaps fenced) to findings, without ever failing on a bad one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.functions.regex import STRIP_CHARS
from lintlake.operators.rulescan import FAMILY_STRIDE
from lintlake.rules import CATEGORIES, FAMILY_ORDER, SEVERITIES

# --- Fixed values: defaults for missing fields --------------------------------------------------
DEFAULT_CATEGORY = "ai_specific"
DEFAULT_SEVERITY = "medium"
DEFAULT_CONFIDENCE = 0.7
DEFAULT_TITLE = "Security Issue"
FENCE = "```"

_NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
_INTEGER = r"^[+-]?\d+(\.0*)?$"
# JSON up to a bare NaN or infinity, over whole strings. Possessive, so one pass; of other JSON no N or I stands outside strings.
_NOT_FINITE = r'\G((?:[^"NI-]++|"(?:[^"\\]++|\\.)*+"|-(?!Infinity))*+)(?<![-\w.])(?:NaN|-?Infinity)'
_NUMERIC_KINDS = "^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*)$"


def unfenced(text: Column) -> Column:
    """Trim; when the text opens with a fence, drop its first and last line."""
    trimmed = F.btrim(text, F.lit(STRIP_CHARS))
    lines = F.split(trimmed, "\n", -1)
    inner = F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 2, F.lit(0))), "\n")
    return F.when(F.startswith(trimmed, F.lit(FENCE)), inner).otherwise(trimmed)


def _finite(json: Column) -> Column:
    """JSON in which a number that is no number, which the reviewers' writers allow, becomes one that no field accepts."""
    return F.when(F.rlike(json, F.lit("NaN|Infinity")), F.regexp_replace(json, _NOT_FINITE, "$1 1e300")).otherwise(json)


def _field(item: Column, name: str) -> Column:
    return F.try_variant_get(item, f"$.{name}", "variant")


def _kind(item: Column, name: str) -> Column:
    """Type of a field: NULL when it is missing, 'VOID' for a JSON null."""
    return F.schema_of_variant(_field(item, name))


def _string(item: Column, name: str) -> Column:
    return F.try_variant_get(item, f"$.{name}", "string")


def _double(item: Column, name: str, grammar: str) -> Column:
    """A number, a boolean or a numeric string as DOUBLE; NULL for anything else."""
    kind = _kind(item, name)
    # Digits may be grouped with underscores, as Python allows.
    text = F.regexp_replace(F.btrim(_string(item, name), F.lit(STRIP_CHARS)), r"(?<=\d)_(?=\d)", "")
    return (
        F.when(F.rlike(kind, F.lit(_NUMERIC_KINDS)), F.try_variant_get(item, f"$.{name}", "double"))
        .when(kind == "BOOLEAN", F.when(F.try_variant_get(item, f"$.{name}", "boolean"), F.lit(1.0)).otherwise(F.lit(0.0)))
        .when((kind == "STRING") & F.rlike(text, F.lit(grammar)), text.try_cast("double"))
    )


def _member(item: Column, name: str, allowed: tuple[str, ...], default: str) -> Column:
    return F.when((_kind(item, name) == "STRING") & _string(item, name).isin(*allowed), _string(item, name)).otherwise(F.lit(default))


def _text(item: Column, name: str, default: str) -> Column:
    """A string field: the default when missing; NULL (= reject) for null or another type."""
    kind = _kind(item, name)
    return F.when(kind.isNull(), F.lit(default)).when(kind == "STRING", _string(item, name))


def normalised(responses: DataFrame, keys: tuple[str, ...] = ("job_id",)) -> DataFrame:
    """Findings stated in (keys..., file_path, model_used, response_text).

    Unreadable text, a root or ``findings`` of the wrong type and list members that are not objects give
    nothing; a member with a value outside its type or range (``NaN`` too) is left out alone.
    """
    items = F.try_variant_get(F.try_parse_json(_finite(unfenced(F.col("response_text")))), "$.findings", "array<variant>")
    rows = (
        responses.select(*keys, "file_path", "model_used", F.posexplode_outer(items).alias("pos", "item"))
        .filter(F.col("item").isNotNull())
    )
    item = F.col("item")

    def line(name: str) -> Column:
        return _double(item, name, _INTEGER)

    def no_line(name: str) -> Column:
        return F.coalesce(_kind(item, name) == "VOID", F.lit(True))

    def good_line(name: str) -> Column:
        value = F.col(f"_{name}")
        return F.col(f"_no_{name}") | ((value == F.floor(value)) & (F.abs(value) < 2147483648.0))

    kind_evidence = _kind(item, "masked_evidence")
    read = rows.select(
        *keys, "file_path", "model_used", "pos",
        F.startswith(F.schema_of_variant(item), F.lit("OBJECT")).alias("_object"),
        _member(item, "category", CATEGORIES, DEFAULT_CATEGORY).alias("category"),
        _member(item, "severity", SEVERITIES, DEFAULT_SEVERITY).alias("severity"),
        F.when(_kind(item, "confidence").isNull(), F.lit(DEFAULT_CONFIDENCE))
        .otherwise(_double(item, "confidence", _NUMBER)).alias("confidence"),
        _text(item, "title", DEFAULT_TITLE).alias("title"),
        _text(item, "description", "").alias("description"),
        _text(item, "fix_suggestion", "").alias("fix_suggestion"),
        F.when(kind_evidence == "STRING", _string(item, "masked_evidence")).alias("masked_evidence"),
        F.coalesce(kind_evidence.isin("STRING", "VOID"), F.lit(True)).alias("_evidence_ok"),
        line("line_start").alias("_line_start"), no_line("line_start").alias("_no_line_start"),
        line("line_end").alias("_line_end"), no_line("line_end").alias("_no_line_end"),
    )
    good = (
        F.col("_object") & F.col("confidence").between(0.0, 1.0) & F.col("title").isNotNull()
        & F.col("description").isNotNull() & F.col("fix_suggestion").isNotNull() & F.col("_evidence_ok")
        & good_line("line_start") & good_line("line_end")
    )
    return read.filter(good).select(
        *keys,
        "file_path",
        F.col("_line_start").cast("int").alias("line_start"),
        F.col("_line_end").cast("int").alias("line_end"),
        "category", "severity", "confidence", "title", "description", "masked_evidence", "fix_suggestion",
        F.lit(None).cast("string").alias("code_snippet"),
        F.col("model_used").alias("detected_by"),
        F.lit("REVIEW").alias("rule_id"),
        (F.lit(FAMILY_ORDER.index("review") * FAMILY_STRIDE) + F.col("pos")).cast("bigint").alias("det_ordinal"),
    )
