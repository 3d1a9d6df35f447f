"""Constraint checks, additive flags and the readiness gate."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers
from ..functions.text import strip
from ..model import FIELD_TYPES, LENIENT_ROWS, MAX_FIELDS, MAX_NAME_LENGTH, Field
from ..session import settle
from .common import union_all
from .convert import bind, convert_field, raw_value

STRICTNESS = ("strict", "lenient")
STAGES = ("review", "confirm")


def fold_case(c: Column) -> Column:
    """One form of a text whatever its case: capitals, in which the micro sign meets mu and sharp s meets ss.

    Lower case of them would not do: the optimizer turns lower(upper(x)) into lower(x).
    """
    return F.upper(c)


def check_allowed(v: Column, f: Column) -> Column:
    """V1: message for a value outside the allowed set, or blank in a required field; else null."""
    text = strip(v)
    allowed = F.transform(f["allowed_values"], fold_case)
    listed = F.array_join(f["allowed_values"], ", ")
    return F.when(
        f["allowed_values"].isNotNull(),
        F.when(
            text == "",
            F.when(F.coalesce(f["required"], F.lit(True)), F.concat(F.lit("'"), v, F.lit("' is blank in a required field"))),
        ).when(
            ~F.array_contains(allowed, fold_case(text)),
            F.concat(F.lit("'"), v, F.lit("' is outside the allowed values ("), listed, F.lit(")")),
        ),
    )


def check_bounds(v: Column, locale: Column, f: Column) -> Column:
    """V2: message for a number outside its bounds, NaN and infinities included; text is skipped."""
    x = F.when(locale == numbers.DECIMAL_COMMA, numbers.decimal_comma(v)).otherwise(numbers.to_float(v))
    infinite = F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.when(
        (f["min"].isNotNull() | f["max"].isNotNull()) & x.isNotNull(),
        F.when(infinite, F.concat(F.lit("'"), v, F.lit("' has no finite value")))
        .when(x < f["min"], F.concat(x.cast("string"), F.lit(" is below the minimum "), f["min"].cast("string")))
        .when(x > f["max"], F.concat(x.cast("string"), F.lit(" is above the maximum "), f["max"].cast("string"))),
    )


def violation(v: Column, locale: Column, f: Column) -> Column:
    """V1 then V2; an optional blank in an allowed-values field skips every further check."""
    skip = f["allowed_values"].isNotNull() & (strip(v) == "") & ~F.coalesce(f["required"], F.lit(True))
    return F.when(v.isNotNull() & ~skip, F.coalesce(check_allowed(v, f), check_bounds(v, locale, f)))


def candidates(mappings: DataFrame, stage: str = "review") -> DataFrame:
    """V4: the columns to judge per field: the chosen one, and at review every ranked alternative.

    `rank` 0 is the chosen column; a column named twice keeps its first rank.
    """
    if stage not in STAGES:
        raise ValueError(f"stage must be one of {', '.join(STAGES)}, not {stage!r}")
    chosen = F.array(F.col("source_column"))
    others = F.transform(F.coalesce("alternatives", F.array().cast("array<struct<source_column:string,confidence:double>>")), lambda a: a["source_column"])
    names = F.array_distinct(F.concat(chosen, others)) if stage == "review" else chosen
    return (
        mappings.select("dataset_id", "target_field", F.posexplode(names).alias("rank", "source_column"))
        .filter(F.col("source_column").isNotNull())
    )


def first_rows(rows: DataFrame, n: int) -> DataFrame:
    """L7 for unfenced rows: the first n by position; a group limit runs before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("dataset_id").orderBy("row_idx"))
    return rows.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


_DECLARED = ("type", "unit", "allowed_values", "required", "min", "max", "declared_format")
_SPOT = ("col_idx", "locale", "resolved_format", "constant")
SLOTS = 64  # checks of one pass; a field set and its ranked alternatives seldom need more


class Slot(NamedTuple):
    """One check of a pass: a declared field and the rank of the column it is judged on."""

    field: Field
    rank: int

    @property
    def of(self) -> Column:
        """Which checks are this slot's. Fields of one name can be declared differently by datasets of different schemas."""
        f = self.field
        allowed = None if f.allowed_values is None else F.array(*map(F.lit, f.allowed_values)).cast("array<string>")
        same = [
            F.col(c).eqNullSafe(v if isinstance(v, Column) else F.lit(v))
            for c, v in (("type", f.type), ("unit", f.unit), ("allowed_values", allowed), ("required", f.required), ("min", f.min), ("max", f.max), ("declared_format", f.date_format))
        ]
        return reduce(lambda a, b: a & b, same, (F.col("target_field") == f.name) & (F.col("rank") == self.rank))


def slots_of(checks: DataFrame) -> list[Slot]:
    """The different checks of an inventory: as many as declared fields and ranks, whatever the number of datasets."""
    found = checks.select("target_field", "rank", *_DECLARED).distinct().collect()
    slots = [
        Slot(Field(r.target_field, r.type, None if r.allowed_values is None else tuple(r.allowed_values), r.unit, r.required, r.min, r.max, r.declared_format), r.rank) for r in found
    ]
    return sorted(slots, key=lambda s: (s.field.name, s.rank, repr(s.field)))


def _objection(slot: Slot, text: Column, number: Column, raw: Column) -> Column:
    """Whether V1 or V2 objects: `violation` without its message, the declaration known when the plan is built."""
    f, bad = slot.field, F.lit(False)
    required = f.required is None or f.required
    if f.min is not None or f.max is not None:
        infinite = F.isnan(number) | (F.abs(number) == F.lit(float("inf")))
        below = F.lit(False) if f.min is None else number < f.min
        above = F.lit(False) if f.max is None else number > f.max
        bad = F.coalesce(infinite | below | above, F.lit(False))
    if f.allowed_values is not None:
        listed = fold_case(text).isin(*[fold_case(F.lit(a)) for a in f.allowed_values]) if f.allowed_values else F.lit(False)
        bad = F.when(text == "", F.lit(required)).otherwise(~listed | bad)
    return raw.isNotNull() & bad


def verdicts(rows: DataFrame, checks: DataFrame) -> DataFrame:
    """V3 and V7 in one pass: (dataset_id, target_field, rank, source_column, n_rows, n_violations, first_row, n_flagged) of every check.

    `checks` is `bind`'s inventory with a rank. Each dataset's checks are one small record of positions, joined to its rows; a row is never copied for
    a check. A check is a position in that record, and its counts and least violating row are fixed-width accumulators that merge
    from task to task, so a hot dataset shrinks to a row a task before the shuffle.
    """
    checks = settle(checks.select("dataset_id", "target_field", "rank", "source_column", *_DECLARED, *_SPOT))
    slots = slots_of(checks)
    passes = [_verdict_pass(rows, checks, slots[i : i + SLOTS]) for i in range(0, len(slots), SLOTS)]
    return union_all(passes or [_verdict_pass(rows, checks, [])])


def _verdict_pass(rows: DataFrame, checks: DataFrame, slots: list[Slot]) -> DataFrame:
    at = range(len(slots))
    spot = F.struct(*_SPOT, "source_column")
    record = checks.groupBy("dataset_id").agg(F.count("*").alias("_checks"), *(F.max(F.when(s.of, spot)).alias(f"_s{k}") for k, s in enumerate(slots)))
    staged = rows.join(record, "dataset_id")
    staged = staged.select(
        "dataset_id", "row_idx", *(f"_s{k}" for k in at), *(raw_value(F.col("cells"), F.col(f"_s{k}.col_idx"), F.col(f"_s{k}.constant")).alias(f"_r{k}") for k in at)
    )
    texts = {f"_t{k}": strip(F.col(f"_r{k}")) for k in at if slots[k].field.allowed_values is not None}
    numeric = [k for k in at if slots[k].field.min is not None or slots[k].field.max is not None or (slots[k].rank == 0 and slots[k].field.type in ("number", "integer"))]
    numbers_ = {f"_x{k}": F.when(F.col(f"_s{k}.locale") == numbers.DECIMAL_COMMA, numbers.decimal_comma(F.col(f"_r{k}"))).otherwise(numbers.to_float(F.col(f"_r{k}"))) for k in numeric}
    staged = staged.select("*", *(c.alias(n) for n, c in {**texts, **numbers_}.items()))

    def flagged(k: int) -> Column:
        f, raw, locale = slots[k].field, F.col(f"_r{k}"), F.col(f"_s{k}.locale")
        if slots[k].rank:  # an alternative is judged, never converted
            return F.lit(False)
        if f.type in ("number", "integer"):
            parsed = F.when(locale.isin(numbers.DECIMAL_COMMA, numbers.DECIMAL_POINT), F.col(f"_x{k}"))
            bad = numbers.number_flag(raw, locale, parsed)
            return bad | (parsed.isNotNull() & numbers.narrow_to_long(parsed).isNull()) if f.type == "integer" else bad
        return convert_field(f, raw, locale, F.col(f"_s{k}.resolved_format"))[1]

    judged = staged.select(
        "dataset_id", "row_idx",
        *(F.col(f"_s{k}").isNotNull().alias(f"_m{k}") for k in at),
        *(_objection(s, F.col(f"_t{k}"), F.col(f"_x{k}"), F.col(f"_r{k}")).alias(f"_v{k}") for k, s in enumerate(slots)),
        *(F.coalesce(flagged(k), F.lit(False)).alias(f"_f{k}") for k in at),
    )
    sums = [
        c for k in at for c in (
            F.count_if(f"_m{k}").alias(f"_m{k}"), F.count_if(F.col(f"_m{k}") & F.col(f"_v{k}")).alias(f"_v{k}"),
            F.min(F.when(F.col(f"_m{k}") & F.col(f"_v{k}"), F.col("row_idx"))).alias(f"_w{k}"), F.count_if(F.col(f"_m{k}") & F.col(f"_f{k}")).alias(f"_f{k}"),
        )
    ]
    totals = judged.groupBy("dataset_id").agg(F.count("*").alias("_n"), *sums)
    found = [
        F.struct(F.lit(s.field.name).alias("target_field"), F.lit(s.rank).alias("rank"), F.col(f"_m{k}").alias("n_rows"), F.col(f"_v{k}").alias("n_violations"), F.col(f"_w{k}").alias("first_row"), F.col(f"_f{k}").alias("n_flagged"))
        for k, s in enumerate(slots)
    ]
    shape = "array<struct<target_field:string,rank:int,n_rows:bigint,n_violations:bigint,first_row:bigint,n_flagged:bigint>>"
    long = totals.select("dataset_id", F.explode(F.array(*found).cast(shape)).alias("x")).select("dataset_id", "x.*").filter("n_rows > 0")
    return long.join(checks.select("dataset_id", "target_field", "rank", "source_column"), ["dataset_id", "target_field", "rank"])


def with_messages(found: DataFrame, rows: DataFrame, checks: DataFrame) -> DataFrame:
    """V3: (dataset_id, target_field, rank, source_column, row_idx, message, n_violations) of the verdicts that object; only the first violating rows
    are looked up again for their message."""
    first = found.filter(F.col("n_violations") > 0).select("dataset_id", "target_field", "rank", "n_violations", F.col("first_row").alias("row_idx"))
    cells = rows.join(first, ["dataset_id", "row_idx"]).join(checks, ["dataset_id", "target_field", "rank"])
    whole = F.struct(*_DECLARED)
    raw = raw_value(F.col("cells"), F.col("col_idx"), F.col("constant"))
    said = cells.withColumn("_raw", raw).withColumn("_whole", whole).withColumn("message", violation(F.col("_raw"), F.col("locale"), F.col("_whole")))
    best = F.min(F.struct("row_idx", "message")).alias("_f")  # of rows that share a position
    return (
        said.groupBy("dataset_id", "target_field", "rank", "source_column", "n_violations").agg(best)
        .select("dataset_id", "target_field", "rank", "source_column", "_f.row_idx", "_f.message", "n_violations")
    )


def first_violations(rows: DataFrame, checks: DataFrame) -> DataFrame:
    """V3: the first violating row and its message per (dataset, field, candidate)."""
    checks = settle(checks.select("dataset_id", "target_field", "rank", "source_column", *_DECLARED, *_SPOT))
    return with_messages(settle(verdicts(rows, checks)), rows, checks)


def bound_checks(bound: DataFrame) -> DataFrame:
    """The chosen columns and constants of `bind`'s inventory as checks of rank 0."""
    return bound.filter(F.col("col_idx").isNotNull() | F.col("constant").isNotNull()).withColumn("rank", F.lit(0))


def conversion_objections(rows: DataFrame, bound: DataFrame) -> DataFrame:
    """V7 input: fields any row of which failed its conversion; always over all rows."""
    return verdicts(rows, bound_checks(bound)).filter("n_flagged > 0").select("dataset_id", "target_field", "n_flagged")


def field_counts(rows: DataFrame, bound: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """dataset_id, target_field, rows, converted, violations; from verdicts already found, or from a pass of its own."""
    found = verdicts(rows, bound_checks(bound)) if found is None else found.filter(F.col("rank") == 0)
    return found.select("dataset_id", "target_field", F.col("n_rows").alias("rows"), (F.col("n_rows") - F.col("n_flagged")).alias("converted"), F.col("n_violations").alias("violations"))


def inferred_violation(b: Column) -> Column:
    """V5: an inferred value meets the same checks, with no locale."""
    return F.when(b["inferred_value"].isNotNull(), violation(b["inferred_value"], F.lit(None).cast("string"), b))


def validate(
    mappings: DataFrame,
    columns: DataFrame,
    rows: DataFrame,
    fields: DataFrame,
    formats: DataFrame | None = None,
    contradictions: DataFrame | None = None,
    strictness: str = "strict",
    stage: str = "review",
) -> DataFrame:
    """Mappings with `validator_note`; flags are only ever raised, never cleared."""
    return judge(mappings, columns, rows, fields, formats, contradictions, strictness, stage).mappings


class Judged(NamedTuple):
    mappings: DataFrame
    verdicts: DataFrame | None  # over all rows; none where lenient judging read only the first


def judge(
    mappings: DataFrame,
    columns: DataFrame,
    rows: DataFrame,
    fields: DataFrame,
    formats: DataFrame | None = None,
    contradictions: DataFrame | None = None,
    strictness: str = "strict",
    stage: str = "review",
) -> Judged:
    """V10 with the verdicts it rests on: constraints, conversions and counts of all candidate columns from one pass over the rows."""
    if strictness not in STRICTNESS:
        raise ValueError(f"strictness must be one of {', '.join(STRICTNESS)}, not {strictness!r}")
    key = ["dataset_id", "target_field"]
    bound = bind(mappings, columns, fields, formats)
    picked = candidates(mappings, stage).withColumnRenamed("source_column", "_candidate")
    judged = (
        bind(
            mappings.drop("source_column").join(picked, key).withColumnRenamed("_candidate", "source_column"),
            columns, fields, formats,
        )
        .filter(F.col("col_idx").isNotNull())
    )
    constants = bound_checks(bound).filter(F.col("col_idx").isNull())
    checks = settle(judged.unionByName(constants, allowMissingColumns=True).select("dataset_id", "target_field", "rank", "source_column", *_DECLARED, *_SPOT))
    on_columns = checks.filter(F.col("col_idx").isNotNull() & (F.col("allowed_values").isNotNull() | F.col("min").isNotNull() | F.col("max").isNotNull()))
    if strictness == "lenient":
        scope = first_rows(rows, LENIENT_ROWS)
        seen = verdicts(rows, checks.filter(F.col("rank") == 0))
        found = first_violations(scope, on_columns)
    else:
        seen = settle(verdicts(rows, checks))
        found = with_messages(seen, rows, on_columns)
    label = F.when(F.col("source_column") == "", "(no header)").otherwise(F.col("source_column"))
    per_field = found.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct("rank", F.concat(F.lit("column '"), label, F.lit("': "), F.col("message")).alias("note")))).alias("_n")
    ).select(*key, F.transform("_n", lambda n: n["note"]).alias("_column_notes"))
    flagged = seen.filter((F.col("rank") == 0) & (F.col("n_flagged") > 0)).select(*key, "n_flagged")
    joined = bound.join(per_field, key, "left").join(flagged, key, "left")
    if contradictions is None:
        joined = joined.withColumn("example_value", F.lit(None).cast("string"))
    else:
        joined = joined.join(contradictions.select(*key, "example_value"), key, "left")
    whole = F.struct("inferred_value", "allowed_values", "required", "min", "max")
    inferred = joined.withColumn("_whole", whole)
    contradiction_note = F.when(
        F.col("example_value").isNotNull(),
        F.concat(F.lit("declared format "), F.col("declared_format"), F.lit(" disagrees with values such as '"), F.col("example_value"), F.lit("'")),
    )
    conversion_note = F.when(
        F.col("n_flagged").isNotNull(),
        F.when(
            (F.col("type") == "date") & F.col("declared_format").isNull(),
            "this date field has no format, declared or found in its values; mapping it elsewhere does not mend that",
        ).otherwise("a value failed its number, date or unit conversion"),
    )
    inferred_note = F.concat(F.lit("inferred value: "), inferred_violation(F.col("_whole")))
    notes = F.concat(
        F.array_compact(F.array(contradiction_note, conversion_note)),
        F.coalesce("_column_notes", F.array().cast("array<string>")),
        F.array_compact(F.array(inferred_note)),
    )
    constrained = (
        F.col("type").isNotNull() | F.col("allowed_values").isNotNull() | F.col("unit").isNotNull()
        | F.col("min").isNotNull() | F.col("max").isNotNull()
    )
    noted = inferred.withColumn("_notes", notes).select(
        *mappings_without(mappings, "needs_confirmation", "validator_note"),
        (F.col("needs_confirmation") | (constrained & (F.size("_notes") > 0))).alias("needs_confirmation"),
        F.when(~constrained, "no constraints declared for this field")
        .when(F.size("_notes") > 0, F.array_join("_notes", "; "))
        .otherwise("no violation found")
        .alias("validator_note"),
    )
    return Judged(noted, None if strictness == "lenient" else seen)


def mappings_without(mappings: DataFrame, *names: str) -> list[Column]:
    return [F.col(c) for c in mappings.columns if c not in names]


def check_coverage(mappings: DataFrame, names: list[str], datasets: DataFrame | None = None) -> DataFrame:
    """dataset_id, target_field, problem (missing or unknown) where mapping and declaration differ.

    `names` are the declared fields, at most fifty. Datasets with no mapping at all miss every field.
    """
    per_dataset = mappings.groupBy("dataset_id").agg(F.array_sort(F.collect_set("target_field")).alias("_have"))
    if datasets is not None:
        per_dataset = datasets.select("dataset_id").join(per_dataset, "dataset_id", "left").withColumn(
            "_have", F.coalesce("_have", F.array().cast("array<string>"))
        )
    declared = F.array(*[F.lit(n) for n in names]).cast("array<string>")
    problems = F.concat(
        F.transform(F.array_except(declared, F.col("_have")), lambda n: F.struct(n.alias("target_field"), F.lit("missing").alias("problem"))),
        F.transform(F.array_except(F.col("_have"), declared), lambda n: F.struct(n.alias("target_field"), F.lit("unknown").alias("problem"))),
    )
    return per_dataset.select("dataset_id", F.explode(problems).alias("p")).select("dataset_id", "p.*")


def readiness(mappings: DataFrame, datasets: DataFrame | None = None) -> DataFrame:
    """dataset_id, ready, unclear_fields. A dataset without any mapping is not ready."""
    judged = mappings.groupBy("dataset_id").agg(
        F.bool_and(~F.col("needs_confirmation")).alias("ready"),
        F.array_sort(F.collect_set(F.when(F.col("needs_confirmation"), F.col("target_field")))).alias("unclear_fields"),
    )
    if datasets is None:
        return judged
    return datasets.select("dataset_id").join(judged, "dataset_id", "left").select(
        "dataset_id", F.coalesce("ready", F.lit(False)).alias("ready"),
        F.coalesce("unclear_fields", F.array().cast("array<string>")).alias("unclear_fields"),
    )


def check_fields(fields: DataFrame, allow_empty: DataFrame | None = None) -> DataFrame:
    """schema_name, name, error for every declaration that cannot be used.

    `allow_empty` (schema_name, allowed) lists schemas; one without fields errs unless allowed.
    """
    name = strip(F.col("name"))
    error = (
        F.when(F.col("name").isNull() | (F.col("name") == ""), "a field needs a name")
        .when(~name.rlike(r"[\p{L}\p{N}]"), "the name has no letter or digit")
        .when(F.length(name) > MAX_NAME_LENGTH, f"the name is longer than {MAX_NAME_LENGTH} characters")
        .when(name.rlike(r"[\p{C}\p{Zl}\p{Zp}]"), "the name holds a line break or control character")
        .when(F.col("type").isNotNull() & ~F.col("type").isin(*FIELD_TYPES), "unknown field type")
    )
    bad = fields.select("schema_name", "name", error.alias("error")).filter(F.col("error").isNotNull())
    crowded = (
        fields.groupBy("schema_name").agg(F.count("*").alias("_n")).filter(F.col("_n") > MAX_FIELDS)
        .select("schema_name", F.lit(None).cast("string").alias("name"), F.lit(f"more than {MAX_FIELDS} fields").alias("error"))
    )
    result = bad.unionByName(crowded)
    if allow_empty is not None:
        empty = (
            allow_empty.filter(~F.col("allowed")).join(fields.select("schema_name").distinct(), "schema_name", "left_anti")
            .select("schema_name", F.lit(None).cast("string").alias("name"), F.lit("no fields declared").alias("error"))
        )
        result = result.unionByName(empty)
    return result


def check_drift(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """Datasets whose recorded field-set signature is no longer the current one.

    recorded: dataset_id, schema_name, field_set_signature; current: schema_name, signature.
    """
    return recorded.join(current, "schema_name").filter(F.col("field_set_signature") != F.col("signature")).select(
        "dataset_id", "schema_name", "field_set_signature", F.col("signature").alias("current_signature")
    )


# Run states from best to worst.
RUN_STATES = ["exported", "empty", "not_ready"]


def run_report(datasets: DataFrame, rows: DataFrame, ready: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(per-dataset state, one overall row). Datasets without data rows are reported, never mapped."""
    counts = rows.groupBy("dataset_id").agg(F.count("*").alias("n_rows"))
    states = (
        datasets.select("dataset_id").join(counts, "dataset_id", "left").join(ready.select("dataset_id", "ready"), "dataset_id", "left")
        .select(
            "dataset_id", F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
            F.when(F.col("n_rows").isNull(), 1).when(F.coalesce("ready", F.lit(False)), 0).otherwise(2).alias("_level"),
        )
    )
    names = F.array(*[F.lit(s) for s in RUN_STATES])
    report = states.select("dataset_id", "n_rows", F.element_at(names, F.col("_level") + 1).alias("status"))
    overall = states.agg(F.max("_level").alias("_level"), F.count("*").alias("n_datasets")).select(
        F.element_at(names, F.col("_level") + 1).alias("status"), "n_datasets"
    )
    return report, overall
