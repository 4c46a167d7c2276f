"""Chat formatting: layouts by schema fingerprint, a reversible template, a loss mask."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Layout:
    """Declarative mapping of one record layout to turns.

    ``paths`` are the nested field paths of the layout (``[]`` for list items).
    ``items`` names a list with one message per turn, whose ``role`` and ``text``
    fields follow; without it ``fields`` gives (role, path) of single-text
    turns in order, where the texts of equal neighbouring roles are joined by a line feed.
    """

    name: str
    paths: tuple[str, ...]
    items: str | None = None
    role: str | None = None
    text: str | None = None
    fields: tuple[tuple[str, str], ...] = ()

    @property
    def fingerprint(self) -> str:
        return path_fingerprint(self.paths)


#: Common layouts of conversation records.
LAYOUTS = (
    Layout("turn", ("role", "text", "turn"), None, "role", "text"),
    Layout("messages", ("messages", "messages[].content", "messages[].role"),
           "messages", "role", "content"),
    Layout("from_value", ("conversations", "conversations[].from", "conversations[].value"),
           "conversations", "from", "value"),
    Layout("prompt_response", ("prompt", "response"),
           fields=(("user", "prompt"), ("assistant", "response"))),
    Layout("prompt_completion", ("completion", "prompt"),
           fields=(("user", "prompt"), ("assistant", "completion"))),
    Layout("question_answer", ("answer", "question"),
           fields=(("user", "question"), ("assistant", "answer"))),
    Layout("system_question_response", ("question", "response", "system_prompt"),
           fields=(("system", "system_prompt"), ("user", "question"), ("assistant", "response"))),
    Layout("instruction_output", ("instruction", "output"),
           fields=(("user", "instruction"), ("assistant", "output"))),
    Layout("instruction_input_output", ("input", "instruction", "output"),
           fields=(("user", "instruction"), ("user", "input"), ("assistant", "output"))),
)
#: Other names of roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
TURNS = "array<struct<role:string,text:string>>"

#: Fixed values of the template: a turn is ``### role:\n`` text ``\n</turn>\n``.
OPEN, CLOSE = "### ", "\n</turn>\n"
#: Turns without a number come first.
LEAST = -(1 << 40)
#: What is escaped by a backslash inside texts and roles.
CONTROL = r"(\\|###|</turn>)"


def path_fingerprint(paths: Iterable[str]) -> str:
    """Hash of a set of nested field paths."""
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


def schema_paths(kind: T.DataType, prefix: str = "") -> list[str]:
    """Nested field paths of a table's schema."""
    if isinstance(kind, T.StructType):
        found = []
        for field in kind.fields:
            path = f"{prefix}.{field.name}" if prefix else field.name
            found += [path, *schema_paths(field.dataType, path)]
        return found
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{prefix}[]")
    return []


def _record_paths(record: Column, depth: int) -> Column:
    """Nested field paths of a variant, ``depth`` levels of objects deep."""

    def below(value: Column, prefix: Column, level: int) -> Column:
        if level == 0:
            return F.array().cast("array<string>")
        fields = F.try_variant_get(value, "$", "map<string,variant>")
        return F.when(
            fields.isNotNull(),
            F.flatten(
                F.transform(
                    F.map_entries(fields),
                    lambda e: F.concat(
                        F.array(F.concat(prefix, e["key"])),
                        below(e["value"], F.concat(prefix, e["key"], F.lit(".")), level - 1),
                        items(e["value"], F.concat(prefix, e["key"], F.lit("[].")), level - 1),
                    ),
                )
            ),
        ).otherwise(F.array().cast("array<string>"))

    def items(value: Column, prefix: Column, level: int) -> Column:
        if level == 0:
            return F.array().cast("array<string>")
        rows = F.try_variant_get(value, "$", "array<variant>")
        return F.when(
            rows.isNotNull(),
            F.array_distinct(F.flatten(F.transform(rows, lambda r: below(r, prefix, level)))),
        ).otherwise(F.array().cast("array<string>"))

    return below(record, F.lit(""), depth)


def fingerprint_records(record: Column, layouts: Sequence[Layout], depth: int = 2) -> Column:
    """Fingerprint of a variant record over the field paths that the layouts know.

    Other fields (ids, scores, tags) do not change it.
    """
    known = sorted({p for layout in layouts for p in layout.paths})
    paths = F.array_intersect(_record_paths(record, depth), F.array(*map(F.lit, known)))
    return F.sha2(F.array_join(F.array_sort(paths), "\n"), 256)


def _plain(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def _role(value: Column) -> Column:
    for alias, role in ROLES.items():
        value = F.when(value == alias, role).otherwise(value)
    return _plain(value)


def _turns(record: Column, layout: Layout) -> Column:
    """Turns of a variant record by its layout."""

    def get(value: Column, path: str) -> Column:
        return F.try_variant_get(value, f"$['{path}']", "string")

    if layout.items:
        rows = F.try_variant_get(record, f"$['{layout.items}']", "array<variant>")
        return F.transform(
            rows,
            lambda r: F.struct(
                _role(get(r, layout.role)).alias("role"), _plain(get(r, layout.text)).alias("text")
            ),
        ).cast(TURNS)
    if not layout.fields:
        return F.array(
            F.struct(
                _plain(get(record, layout.role)).alias("role"),
                _plain(get(record, layout.text)).alias("text"),
            )
        ).cast(TURNS)
    joined: list[tuple[str, list[Column]]] = []
    for role, path in layout.fields:
        if joined and joined[-1][0] == role:
            joined[-1][1].append(get(record, path))
        else:
            joined.append((role, [get(record, path)]))
    return F.array(
        *[
            F.struct(
                F.lit(role).alias("role"),
                F.concat_ws("\n", *[F.nullif(t, F.lit("")) for t in texts]).alias("text"),
            )
            for role, texts in joined
        ]
    ).cast(TURNS)


def canonical_turns(
    records: DataFrame, record: str = "record", layouts: Sequence[Layout] = LAYOUTS
) -> DataFrame:
    """Add ``layout`` (its name) and ``turns`` (role, text) to JSON records of mixed layouts.

    The fingerprint of a record's nested field paths selects the mapping. A
    record that is null, no JSON or of no known layout keeps its row, with null
    ``layout`` and ``turns``. Null texts become empty.
    """
    parsed = records.withColumn("__v", F.try_parse_json(record)).withColumn(
        "__f", F.when(F.col("__v").isNotNull(), fingerprint_records(F.col("__v"), layouts))
    )
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for layout in layouts:
        chosen = F.col("__f") == layout.fingerprint
        name = F.when(chosen, layout.name).otherwise(name)
        turns = F.when(chosen, _turns(F.col("__v"), layout)).otherwise(turns)
    return parsed.select("*", name.alias("layout"), turns.alias("turns")).drop("__v", "__f")


def turn_rows(
    table: DataFrame, conv: str = "conv_id", turn: str = "turn", layouts: Sequence[Layout] = LAYOUTS
) -> DataFrame:
    """(``conv_id``, ``turn``, ``role``, ``text``) of a typed table with one row per turn.

    The fingerprint of the table's own field paths selects the mapping; columns
    that no layout by rows knows are ignored. A table of another layout is an error.
    """
    by_row = [layout for layout in layouts if layout.role and not layout.items]
    known = {p for layout in by_row for p in layout.paths}
    found = path_fingerprint(known.intersection(schema_paths(table.schema)))
    for layout in by_row:
        if layout.fingerprint == found:
            return table.select(
                F.col(conv).alias("conv_id"),
                F.col(turn).cast("bigint").alias("turn"),
                _plain(F.col(layout.role)).alias("role"),
                _plain(F.col(layout.text)).alias("text"),
            )
    raise ValueError(f"no layout for a table of {sorted(table.columns)}")


def record_rows(
    records: DataFrame, conv: str = "conv_id", record: str = "record",
    layouts: Sequence[Layout] = LAYOUTS,
) -> DataFrame:
    """The same rows from JSON records; records without a known layout give none."""
    return (
        canonical_turns(records, record, layouts)
        .select(F.col(conv).alias("conv_id"), F.posexplode("turns").alias("turn", "t"))
        .select("conv_id", F.col("turn").cast("bigint").alias("turn"), "t.role", "t.text")
    )


def _escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"\\$1")


def _unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_turns(turns: DataFrame, trained: Sequence[str] = ("assistant",)) -> DataFrame:
    """Formatted segment of each turn, with its loss span.

    A segment is ``### role:``, a line feed, the text, a line feed, ``</turn>`` and
    a line feed. Backslashes, ``###`` and ``</turn>`` in a text get a backslash in
    front, and so do colons and line feeds of a role, so that a control string
    never occurs unescaped and the format is reversible. ``loss_start`` and ``loss_chars`` (code
    points) give the text of ``trained`` roles inside the segment; they are null
    for others. A conversation is its segments in order of ``turn``.

    Segments are one row per turn, so that a conversation of any length is
    never one row here.
    """
    role, text = F.col("role"), _escape(_plain(F.col("text")))
    head = F.concat(
        F.lit(OPEN), F.regexp_replace(_escape(_plain(role)), "([:\n])", r"\\$1"), F.lit(":\n")
    )
    train = role.isin(*trained)
    return turns.select(
        "conv_id",
        "turn",
        F.concat(head, text, F.lit(CLOSE)).alias("segment"),
        F.when(train, F.char_length(head)).alias("loss_start"),
        F.when(train, F.char_length(text)).alias("loss_chars"),
    )


def read_back(segments: DataFrame) -> DataFrame:
    """Role, text and trained text of each segment, parsed from the format alone."""
    segment = F.col("segment")
    head = F.regexp_extract(segment, r"(?s)^### ((?:[^:\\]++|\\.)*+):\n", 1)
    body = F.char_length(head) + len(OPEN) + 2
    return segments.select(
        "conv_id",
        "turn",
        _unescape(head).alias("role"),
        _unescape(
            F.substring(segment, body + 1, F.char_length(segment) - body - len(CLOSE))
        ).alias("text"),
        F.when(
            F.col("loss_start").isNotNull(),
            _unescape(F.substring(segment, F.col("loss_start") + 1, F.col("loss_chars"))),
        ).alias("loss_text"),
        F.char_length(segment).cast("bigint").alias("chars"),
    )


def conversation_digests(segments: DataFrame, chunk: int = 256) -> DataFrame:
    """Digests of whole conversations, read back from their segments.

    ``conv_id``, ``n_turns``, ``turns_sha256`` (role, line feed, text, line feed per
    turn), ``loss_chars``, ``loss_sha256``, ``formatted_chars``. A hash of a whole
    conversation needs its whole text in one value; turns are first joined in
    chunks of ``chunk`` turn numbers, so that no sort sees more than a chunk.
    Turns without a number come first; turns of
    equal number go by role, then text.
    """
    rows = read_back(segments).withColumn(
        "part", F.floor(F.coalesce("turn", F.lit(LEAST)) / chunk).cast("bigint")
    )

    def joined(column: str) -> Column:
        return F.array_join(F.transform("rows", lambda r: r[column]), "")

    parts = (
        rows.groupBy("conv_id", "part")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        F.isnotnull("turn").alias("known"),
                        "turn",
                        "role",
                        "text",
                        F.concat("role", F.lit("\n"), "text", F.lit("\n")).alias("said"),
                        _plain(F.col("loss_text")).alias("loss"),
                    )
                )
            ).alias("rows"),
            F.count(F.lit(1)).alias("n"),
            F.sum("chars").alias("chars"),
        )
        .select("conv_id", "part", "n", "chars", joined("said").alias("said"), joined("loss").alias("loss"))
    )
    return (
        parts.groupBy("conv_id")
        .agg(
            F.array_sort(F.collect_list(F.struct("part", "said", "loss"))).alias("rows"),
            F.sum("n").alias("n_turns"),
            F.sum("chars").alias("formatted_chars"),
        )
        .select(
            "conv_id",
            "n_turns",
            F.sha2(joined("said"), 256).alias("turns_sha256"),
            F.char_length(joined("loss")).cast("bigint").alias("loss_chars"),
            F.sha2(joined("loss"), 256).alias("loss_sha256"),
            "formatted_chars",
        )
    )
