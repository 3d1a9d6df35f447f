"""Declared target fields and the frames every operator takes and returns.

Frames (all DataFrames):

* grid      file_id, sheet, row_idx, cells array<struct<v,t>>   raw sheet rows with cell types
* datasets  dataset_id, source_file, sheet, table_idx, origin_sheet, label
* columns   dataset_id, col_idx, header                          headers only, no values
* rows      dataset_id, row_idx, cells array<string>             data rows, cells in column order
* mappings  dataset_id, target_field, source_column, confidence, reasoning,
            needs_confirmation, inferred_value, alternatives
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Semantics the tests pin.
HEADER_SCAN_ROWS = 15
HEADER_TYPE_WINDOW = 5
HEADER_MARGIN = 0.05
SHEET_MARGIN = 0.1
SHEET_WIDTH_SATURATION = 0.5
SHEET_MIN_ROWS = 2
TRANSPOSED_MARGIN = 0.1
WIDE_MATRIX_MIN_COLUMNS = 3
WIDE_MATRIX_MIN_FRACTION = 0.4
LAYOUT_CONFIRMATION_BAR = 0.9
NEAR_MAX_EDITS = 2
NEAR_MAX_RATIO = 0.34
LENIENT_ROWS = 6
MAX_FIELDS = 50
MAX_NAME_LENGTH = 64
EVIDENCE_LEAD_IN = 2
EVIDENCE_ROWS = 8
EVIDENCE_GRID_ROWS = 60
EVIDENCE_GRID_COLUMNS = 10
PENDING_TTL_HOURS = 24
FIELD_TYPES = ("number", "integer", "date", "text")
SOURCE_SHEET = "__source_sheet"

FIELD_SCHEMA = (
    "schema_name string, pos int, name string, description string, type string, "
    "allowed_values array<string>, unit string, required boolean, min double, max double, date_format string"
)
ALTERNATIVES = "array<struct<source_column:string,confidence:double>>"
MAPPING_SCHEMA = (
    "dataset_id string, target_field string, source_column string, confidence double, reasoning string, "
    f"needs_confirmation boolean, inferred_value string, alternatives {ALTERNATIVES}"
)
BLOCK = "struct<label_column:int,value_columns:array<int>,first_row:bigint,last_row:bigint>"
TABLE = "struct<header_row_index:bigint,first_data_row:bigint,last_data_row:bigint,title_row_index:bigint>"
LAYOUT_SCHEMA = (
    "file_id string, sheet string, kind string, confidence double, reasoning string, "
    "header_row_index bigint, first_data_row bigint, last_data_row bigint, "
    f"key_value_blocks array<{BLOCK}>, one_record_per_value_column boolean, tables array<{TABLE}>"
)
HINT = (
    "struct<header_row:bigint,sheet:string,delimiter:string,decimal_separator:string,layout:"
    "struct<kind:string,confidence:double,header_row_index:bigint,first_data_row:bigint,last_data_row:bigint,"
    f"key_value_blocks:array<{BLOCK}>,one_record_per_value_column:boolean,tables:array<{TABLE}>>>"
)


@dataclass(frozen=True)
class Field:
    """One declared target field."""

    name: str
    type: str | None = None
    allowed_values: tuple[str, ...] | None = None
    unit: str | None = None
    required: bool = True
    min: float | None = None
    max: float | None = None
    date_format: str | None = None
    description: str | None = None

    @property
    def constrained(self) -> bool:
        declared = (self.type, self.allowed_values, self.unit, self.min, self.max)
        return any(value is not None for value in declared)


@dataclass(frozen=True)
class FieldSet:
    """An ordered, named set of declared fields: configuration, at most fifty entries."""

    name: str
    fields: tuple[Field, ...]

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    def frame(self, spark: SparkSession) -> DataFrame:
        """The declarations as a `fields` frame."""
        rows = [
            (
                self.name, pos, f.name, f.description, f.type,
                list(f.allowed_values) if f.allowed_values is not None else None,
                f.unit, f.required,
                None if f.min is None else float(f.min),
                None if f.max is None else float(f.max),
                f.date_format,
            )
            for pos, f in enumerate(self.fields)
        ]
        return spark.createDataFrame(rows, FIELD_SCHEMA)

    def to_json(self) -> str:
        return json.dumps({"name": self.name, "fields": [asdict(f) for f in self.fields]}, ensure_ascii=False)


class Tables(NamedTuple):
    """One corpus of datasets: three lazy frames sharing `dataset_id`."""

    datasets: DataFrame
    columns: DataFrame
    rows: DataFrame


def dataset_id(source_file: Column, sheet: Column, table_idx: Column) -> Column:
    """A stable id for one table of one sheet of one file."""
    blank = F.lit("")
    return F.sha2(
        F.concat_ws(
            "\x1f",
            F.coalesce(source_file, blank), F.coalesce(sheet, blank), F.coalesce(table_idx.cast("string"), blank),
        ),
        256,
    )


def empty_alternatives() -> Column:
    return F.array().cast(ALTERNATIVES)


def mapping_columns(**given: Column) -> list[Column]:
    """The mapping columns in order, with defaults for what a stage does not set."""
    defaults = {
        "dataset_id": F.col("dataset_id"),
        "target_field": F.col("target_field"),
        "source_column": F.lit(None).cast("string"),
        "confidence": F.lit(0.0),
        "reasoning": F.lit(None).cast("string"),
        "needs_confirmation": F.lit(False),
        "inferred_value": F.lit(None).cast("string"),
        "alternatives": empty_alternatives(),
    }
    return [given.get(name, default).alias(name) for name, default in defaults.items()]
