"""Lineage counts, privacy audits and run records."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contrastry.session import materialize

# Column names and value patterns that identify individuals.
FORBIDDEN_COLUMNS = frozenset((
    "aliquot_id", "case_id", "case_submitter_id", "donor_id", "donor_key", "gtex_sample_id", "individual_id", "participant_id",
    "patient_id", "patient_key", "portion_id", "sample_id", "sample_key", "submitter_id",
))
INDIVIDUAL_PATTERNS = (
    r"(?i)^(?:PATIENT|SAMPLE|CASE|DONOR):", r"(?i)^TCGA-[A-Z0-9]{2}-[A-Z0-9]{4}(?:-|$)", r"(?i)^GTEX-[A-Z0-9]{4,}(?:-|$)",
)
STUB = "stub|placeholder|demo"


def traceability(outcomes: DataFrame, silver: Mapping[str, DataFrame]) -> DataFrame:
    """Selection outcomes against parsed rows per (project, modality).

    ``outcomes`` is (project_id, modality, status) with one row per candidate file;
    ``silver`` maps a modality to its table with ``project_id`` and ``data_origin``.
    """
    def of(*statuses: str) -> Column:
        return F.count_if(F.col("status").isin(*statuses))

    files = outcomes.groupBy("project_id", "modality").agg(
        F.count(F.lit(1)).alias("candidate_files"), F.count_if(F.col("status") != "not_selected").alias("selected_files"),
        of("downloaded").alias("downloaded_files"), of("skipped").alias("skipped_existing_files"), of("failed").alias("failed_files"),
        of("downloaded", "skipped").alias("local_available_files"),
    )
    parsed = None
    for modality, df in silver.items():
        origin = F.lower(F.coalesce(F.col("data_origin").cast("string"), F.lit("")))
        one = df.groupBy("project_id").agg(
            F.count(F.lit(1)).alias("silver_parsed_rows"), F.count_distinct("data_origin").alias("silver_unique_source_files"), F.count_if(origin.rlike(STUB)).alias("silver_stub_rows")
        ).withColumn("modality", F.lit(modality))
        parsed = one if parsed is None else parsed.unionByName(one)
    joined = files.join(parsed, ["project_id", "modality"], "full")
    counts = [c for c in joined.columns if c not in ("project_id", "modality")]
    filled = joined.fillna(0, counts)
    local = F.col("local_available_files")
    return filled.select(
        "project_id", "modality", *counts,
        F.round(F.try_divide(F.col("silver_unique_source_files").cast("double"), local), 4).alias("parsed_vs_local_file_ratio"),
        F.concat_ws(
            ";", F.when((local > 0) & (F.col("silver_parsed_rows") == 0), "local_files_without_parsed_rows"), F.when(F.col("silver_stub_rows") > 0, "stub_origin_rows")
        ).alias("warnings"),
    )


def selection_counters(outcomes: DataFrame, statuses: Sequence[str] = ("downloaded", "skipped", "failed", "not_selected")) -> DataFrame:
    """Files per (project, modality) and outcome, one column per outcome."""
    return outcomes.groupBy("project_id", "modality").pivot("status", list(statuses)).agg(F.count(F.lit(1))).fillna(0)


def forbidden_columns(df: DataFrame) -> list[str]:
    """Identifier columns by canonical name; a check of the schema alone."""
    return sorted(c for c in df.columns if re.sub(r"[^a-z0-9]+", "_", c.lower()).strip("_") in FORBIDDEN_COLUMNS)


def forbidden_column_audit(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Identifier columns of each table and how many rows fill them; one aggregation per table."""
    out = spark.createDataFrame([], "table_name string, column_name string, filled_rows long")
    for name, df in tables.items():
        found = forbidden_columns(df)
        if found:
            counts = df.agg(*[F.count_if(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "").alias(c) for c in found])
            pairs = F.create_map(*[x for c in found for x in (F.lit(c), F.col(c))])
            out = out.unionByName(counts.select(F.lit(name).alias("table_name"), F.explode(pairs).alias("column_name", "filled_rows")))
    return out


def individual_values(df: DataFrame) -> DataFrame:
    """Rows with an identifier-like value, per string column; one aggregation for all of them."""
    strings = [f.name for f in df.schema if f.dataType.typeName() == "string"]

    def hit(c: str) -> Column:
        value = F.trim(F.col(c))
        cond = F.lit(False)
        for pattern in INDIVIDUAL_PATTERNS:
            cond = cond | value.rlike(pattern)
        return F.count_if(cond)

    counts = df.agg(*[hit(c).alias(c) for c in strings])
    return counts.select(F.explode(F.create_map(*[x for c in strings for x in (F.lit(c), F.col(c))])).alias("column_name", "individual_like_rows"))


def require_public(df: DataFrame, name: str) -> None:
    """Raise unless a table is non-empty and free of identifiers."""
    if not df.limit(1).count():
        raise ValueError(f"public table is empty: {name}")
    if forbidden_columns(df):
        raise ValueError(f"{name} has identifier columns: {forbidden_columns(df)}")
    if individual_values(df).where("individual_like_rows > 0").limit(1).count():
        raise ValueError(f"{name} has identifier-like values")


def leaked_identifiers(
    texts: DataFrame, identifiers: DataFrame, *, text: str = "text", identifier: str = "identifier", min_length: int = 6,
    piece: int = 1 << 16, cells: int = 1 << 20,
) -> DataFrame:
    """Identifiers that occur anywhere in a text, also inside longer words, and in how many texts.

    A place of a text is a candidate if its first ``min_length`` characters begin some identifier.
    Most places fall to a table of at most ``cells`` bytes inside the row; the others leave the scan
    as hash of the text, position and stem, and meet the stems in an equi-join. Candidates are cut
    out of the text afterwards, one for each length that such identifiers have, and compared whole.
    Texts are scanned in pieces of ``piece`` characters. Shorter identifiers are out of scope, which
    is what ``min_length`` says.
    """
    known = materialize(identifiers.select(F.col(identifier).alias("_id")).where(F.length("_id") >= min_length).distinct(), "identifiers")
    stems = known.groupBy(F.substring("_id", 1, min_length).alias("_stem")).agg(F.collect_set(F.length("_id")).alias("_lengths"))
    size = min(cells, 1 << max(12, (16 * stems.count()).bit_length()))
    marked = bytearray(size)
    for row in stems.select(F.pmod(F.xxhash64("_stem"), F.lit(size)).cast("int").alias("cell")).distinct().collect():  # at most `cells` numbers
        marked[row.cell] = 1

    def begins(place: Column) -> Column:
        return F.substring(F.lit(bytes(marked)), (F.pmod(F.xxhash64(place["stem"]), F.lit(size)) + 1).cast("int"), F.lit(1)) == F.lit(b"\x01")

    keys = ["_first", "_second"]
    bodies = texts.select(F.coalesce(F.col(text), F.lit("")).alias("_body")).where(F.length("_body") >= min_length)
    keyed = bodies.select(F.xxhash64("_body").alias("_first"), F.xxhash64(F.lit(1), "_body").alias("_second"), "_body")
    pieces = keyed.select(*keys, "_body", F.explode(F.sequence(F.lit(0), F.length("_body") - 1, F.lit(piece))).alias("_from")).select(
        *keys, "_from", F.substring("_body", F.col("_from") + 1, F.lit(piece + min_length - 1)).alias("_piece"))
    every = F.regexp_extract_all("_piece", F.lit(f"(?s)(?=(.{{{min_length}}}))."), F.lit(1))  # the stem at each character, in one pass
    places = F.filter(F.transform(every, lambda s, i: F.struct((F.col("_from") + i + 1).alias("at"), s.alias("stem"))), begins)
    hits = (
        pieces.select(*keys, F.explode(places).alias("_place")).select(*keys, F.col("_place.at").alias("at"), F.col("_place.stem").alias("_stem"))
        .join(stems, "_stem").groupBy(*keys).agg(F.collect_set(F.struct("at", "_lengths")).alias("_places"))
    )
    cut = F.flatten(F.transform("_places", lambda p: F.transform(p["_lengths"], lambda n: F.substring(F.col("_body"), p["at"], n))))
    candidates = keyed.join(hits, keys).select(F.explode(F.array_distinct(cut)).alias("_id"))
    return candidates.join(known, "_id").groupBy(F.col("_id").alias(identifier)).agg(F.count(F.lit(1)).alias("occurrences"))


def resource_inventory(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows, columns and logical type counts per table."""
    names = {"string": "string", "long": "integer", "integer": "integer", "short": "integer", "double": "number", "float": "number", "decimal": "number",
             "boolean": "boolean", "date": "date", "timestamp": "datetime"}
    out = None
    for name, df in tables.items():
        kinds = [names.get(f.dataType.typeName(), "any") for f in df.schema]
        one = df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("name"), "row_count", F.lit(len(kinds)).cast("long").alias("column_count"),
            *[F.lit(kinds.count(k)).cast("long").alias(f"{k}_columns") for k in ("string", "integer", "number", "boolean")],
        )
        out = one if out is None else out.unionByName(one)
    return out


def fingerprint(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Order-independent content hash, of the table or of each slice: the sum of row hashes, kept exact as a decimal.

    Spark's hash passes over NULLs, so which columns are NULL is hashed as well: a value that
    moves into an empty neighbour column counts as a change.
    """
    columns = [F.col(c) for c in sorted(df.columns)]
    row = F.xxhash64(*columns, *[c.isNull() for c in columns])
    return df.groupBy(*by).agg(F.sum(row.cast("decimal(38,0)")).cast("string").alias("fingerprint"), F.count(F.lit(1)).alias("row_count"))


def plan_changes(current: DataFrame, frozen: DataFrame, keys: Sequence[str] = ("name",)) -> DataFrame:
    """Every input of two plans as added, removed, changed or unchanged, with its rows before and after.

    Inputs without a row have no fingerprint and equal each other; plans made without
    ``row_count`` are compared by fingerprint alone.
    """
    def side(plan: DataFrame, mark: str) -> DataFrame:
        rows = F.col("row_count") if "row_count" in plan.columns else F.lit(None).cast("long")
        return plan.select(*keys, F.col("fingerprint").alias(f"_print_{mark}"), rows.alias(f"rows_{mark}"), F.lit(True).alias(f"_in_{mark}"))

    kind = (
        F.when(F.col("_in_before").isNull(), "added").when(F.col("_in_after").isNull(), "removed")
        .when(F.col("_print_before").eqNullSafe(F.col("_print_after")), "unchanged").otherwise("changed")
    )
    both = side(frozen, "before").join(side(current, "after"), list(keys), "full")
    return both.select(*keys, kind.alias("change"), "rows_before", "rows_after")


def require_same_plan(current: DataFrame, frozen: DataFrame, keys: Sequence[str] = ("name",)) -> None:
    """Refuse to continue when any input fingerprint differs from the frozen plan."""
    first = plan_changes(current, frozen, keys).where("change <> 'unchanged'").limit(1).collect()  # one row at most
    if first:
        raise ValueError(f"inputs differ from the frozen plan ({first[0].asDict()}); start a new study")


def bounded_history(runs: DataFrame, *, keep: int = 200, started: str = "started_at", run: str = "run_id") -> DataFrame:
    """The latest ``keep`` runs; retention is the point of this operator."""
    return runs.orderBy(F.col(started).desc(), F.col(run).desc()).limit(keep)


def run_record(spark: SparkSession, run_id: str, status: str, started_at: str, finished_at: str, counts: Mapping[str, int]) -> DataFrame:
    """One row to append to the runs table."""
    return spark.createDataFrame(
        [(run_id, status, started_at, finished_at, dict(counts))],
        "run_id string, status string, started_at string, finished_at string, counts map<string,long>",
    )
