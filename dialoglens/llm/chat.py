"""Chat formatting: any record layout to canonical turns, turns to templated text with a loss mask, and back.

The nested field paths of a layout are hashed to a fingerprint, which selects a declarative mapping to canonical turns
(conv_id, turn, role, text). Turns become one text a conversation. Control strings inside roles and texts are escaped:
`<|` gets a backslash between its two characters (`<\\|` a second one, and so on), so that the template's own marks are
the only ones left, and reading back takes one backslash away.

Defined results: NULL role or text is the empty string; turns with one number go by role, then text; a row without
conv_id is a conversation of its own; repeated rows are turns of their own; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

START, END = "<|im_start|>", "<|im_end|>\n"

TURNS_SCHEMA = "conv_id long, turn long, role string, text string"
READ_SCHEMA = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
)


# ---- layouts -------------------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Layout:
    """How a layout becomes turns: `turns` lists (role, field); `each` names an array, its role and its text field.

    Fields in `optional` may be missing in the field paths, and give no turn where they are NULL or empty.
    """

    name: str
    turns: tuple[tuple[str, str], ...] = ()
    each: tuple[str, str, str] | None = None
    rows: tuple[str, str, str] | None = None
    roles: dict[str, str] = field(default_factory=dict)
    optional: frozenset[str] = frozenset()

    def paths(self) -> list[str]:
        if self.each:
            items, role, text = self.each
            return [f"{items}[].{role}", f"{items}[].{text}"]
        return list(self.rows) if self.rows else [name for _, name in self.turns]


LAYOUTS = (
    Layout("turn rows", rows=("turn", "role", "text")),
    Layout("messages", each=("messages", "role", "content")),
    Layout("speakers", each=("conversations", "from", "value"), roles={"human": "user", "gpt": "assistant"}),
    Layout("prompt", turns=(("user", "prompt"), ("assistant", "response"))),
    Layout("completion", turns=(("user", "prompt"), ("assistant", "completion"))),
    Layout("system prompt", turns=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("instruction", turns=(("user", "instruction"), ("assistant", "output"))),
    Layout("instruction with input", turns=(("user", "instruction"), ("user", "input"), ("assistant", "output")),
           optional=frozenset({"input"})),
)


def digest(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()[:16]


BY_FINGERPRINT = {digest(layout.paths()): layout for layout in LAYOUTS}


def schema_paths(schema: T.DataType, at: str = "") -> list[str]:
    """Paths of the leaves; `[]` stands for the elements of an array."""
    if isinstance(schema, T.StructType):
        return [p for f in schema.fields for p in schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(schema, T.ArrayType):
        return schema_paths(schema.elementType, f"{at}[]")
    return [at]


def json_paths(value: object, at: str = "") -> list[str]:
    if isinstance(value, dict):
        return [p for k, v in value.items() for p in json_paths(v, f"{at}.{k}" if at else k)]
    if isinstance(value, list):
        return [p for v in value for p in json_paths(v, f"{at}[]")]
    return [at]


def layout_of(schema: T.StructType, id_column: str = "conv_id", ignore: tuple[str, ...] = ()) -> Layout:
    """Layout whose fingerprint a table's field paths have, beside its id and the columns to ignore."""
    rest = [p for p in schema_paths(schema) if p != id_column and p.split(".")[0].split("[")[0] not in ignore]
    found = BY_FINGERPRINT.get(digest(rest))
    if found is None:
        raise ValueError(f"no mapping for the field paths {sorted(rest)}")
    return found


def to_turns(records: DataFrame, layout: Layout, id_column: str = "conv_id") -> DataFrame:
    """Canonical turns of a table in `layout`; columns that the layout doesn't name are left out."""
    conv = F.col(id_column).cast("long").alias("conv_id")
    if layout.rows:
        turn, role, text = layout.rows
        plain = records.select(conv, F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    elif layout.each:
        items, role, text = layout.each
        plain = records.select(conv, F.posexplode(items).alias("turn", "item")).select(
            "conv_id", F.col("turn").cast("long"), F.col(f"item.{role}").alias("role"), F.col(f"item.{text}").alias("text")
        )
    else:
        made = F.array(*(F.struct(F.lit(role).alias("role"), F.col(name).alias("text"),
                                  F.lit(name in layout.optional).alias("optional")) for role, name in layout.turns))
        plain = (
            records.select(conv, F.posexplode(made).alias("turn", "item"))
            .filter(~(F.col("item.optional") & (F.coalesce("item.text", F.lit("")) == "")))
            .select("conv_id", F.col("turn").cast("long"), "item.role", "item.text")
        )
    role = F.col("role")
    for said, meant in layout.roles.items():
        role = F.when(F.col("role") == said, meant).otherwise(role)
    return plain.select("conv_id", "turn", F.coalesce(role, F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


@F.pandas_udf(T.StringType())
def record_fingerprint(records: pd.Series) -> pd.Series:
    """Fingerprint of each JSON record without its id; NULL for what is no JSON object."""

    def one(text: str | None) -> str | None:
        try:
            value = json.loads(text) if text else None
        except ValueError:
            return None
        return digest(json_paths({k: v for k, v in value.items() if k != "conv_id"})) if isinstance(value, dict) else None

    return records.map(one)


def json_turns(records: DataFrame, column: str = "record") -> tuple[DataFrame, DataFrame]:
    """Canonical turns of mixed JSON records (each with its conv_id), and the records that no mapping fits."""
    marked = records.select(F.col(column).alias("record")).withColumn("fingerprint", record_fingerprint("record"))
    found = None
    for fingerprint, layout in BY_FINGERPRINT.items():
        if layout.each:
            items, role, text = layout.each
            schema = f"conv_id long, `{items}` array<struct<`{role}`: string, `{text}`: string>>"
        elif layout.rows:
            schema = TURNS_SCHEMA
        else:
            schema = "conv_id long, " + ", ".join(f"`{name}` string" for _, name in layout.turns)
        part = marked.filter(F.col("fingerprint") == fingerprint).select(F.from_json("record", schema).alias("r")).select("r.*")
        turns = to_turns(part, layout)
        found = turns if found is None else found.unionByName(turns)
    return found, marked.filter(F.col("fingerprint").isNull() | ~F.col("fingerprint").isin(list(BY_FINGERPRINT)))


# ---- template ------------------------------------------------------------------------------------------------------

def escaped(text):
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def escaped_role(role):
    """A role ends at the line break, so its own line breaks and backslashes are escaped too."""
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def format_turns(turns: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, formatted text and the spans (code points, end exclusive) that the loss covers: texts of `learn`."""
    rows = turns.withColumn("head", F.concat(F.lit(START), escaped_role("role"), F.lit("\n"))).withColumn("body", escaped("text"))
    rows = rows.withColumn("piece", F.concat("head", "body", F.lit(END)))
    item = F.struct("turn", "role", "text", "piece", "span")

    def with_span(frame: DataFrame, before) -> DataFrame:
        start = before + F.length("head")
        span = F.when(F.col("role").isin(*learn), F.struct(start.alias("start"), (start + F.length("body")).alias("end")))
        return frame.withColumn("span", span)

    # counts and order are those of the collected list, so that ties fall alike
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    known = with_span(rows.filter("conv_id IS NOT NULL"), F.coalesce(F.sum(F.length("piece")).over(order), F.lit(0)))
    grouped = known.groupBy("conv_id").agg(F.sort_array(F.collect_list(item)).alias("items"))
    lone = with_span(rows.filter("conv_id IS NULL"), F.lit(0).cast("long")).select("conv_id", F.array(item).alias("items"))
    return grouped.unionByName(lone).select(
        "conv_id",
        F.array_join(F.col("items.piece"), "").alias("formatted"),
        F.filter("items.span", lambda s: s.isNotNull()).alias("loss_spans"),
    )


def read_back(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    out = []
    for piece in formatted.split(START)[1:]:
        role, _, text = piece.removesuffix(END).partition("\n")
        role = re.sub(r"\\(\\|n)", lambda m: "\n" if m[1] == "n" else "\\", unescaped(role))
        out.append((role, unescaped(text)))
    return out


def unescaped(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """What each formatted conversation says, read from its text and its loss spans alone."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, text, spans in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                turns = read_back(text)
                learnt = [unescaped(text[s["start"]:s["end"]]) for s in spans]
                said, loss = hashlib.sha256(), hashlib.sha256()
                for role, words in turns:
                    said.update(f"{role}\n{words}\n".encode())
                for words in learnt:
                    loss.update(words.encode())
                rows.append((conv, len(turns), said.hexdigest(), sum(map(len, learnt)), loss.hexdigest(), len(text)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            names = [f.split()[0] for f in READ_SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(read, READ_SCHEMA)
