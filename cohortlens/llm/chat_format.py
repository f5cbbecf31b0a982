"""Chat formatting by schema fingerprints, with DataFrame operations only.

Of each JSON record, and of a typed table's schema alike, the nested field paths that a layout
asks for are hashed; where the fingerprint is that layout's own, its declarative mapping makes
canonical turns (rows of conversation, order, role, text).  Layouts are tried in their order, with
one fingerprint each.  Records of one column may have a layout each; further fields don't matter.

The template writes each turn as ``### <role>: <text></turn>`` and a line end.  Control
strings inside roles and texts are escaped reversibly: a backslash as two, ``###`` as
backslash h, ``</turn>`` as backslash t, and in roles ``:`` as backslash c, so an unescaped
mark is always the template's own.  The loss mask is the list of spans (code points of the
formatted text) of the assistants' escaped texts.

Edge cases: a null text or role is empty; turns of one number are ordered by role and text;
null conversation ids are one conversation; repeated rows are repeated turns; an empty table
gives no rows; columns besides those of the layout are not looked at.  Records that are null,
not JSON, with a key twice, not an object, of no known layout, or whose list of turns is empty or
null give no turns and are listed with the reason by :func:`rejected_records`; none stops the job.  A typed table of no
known layout is an error that names its fields.  A text that isn't one (a list of parts)
becomes its JSON.  A conversation becomes one row by definition, so it must fit in a row, but
no other group is gathered.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

TURN_END = "</turn>\n"
ASSISTANT = "assistant"


def _turn(role: str, text: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), text.alias("text"))


def _text(path: str) -> Column:
    return F.try_variant_get("v", path, "string")


def _listed(path: str, role: str, text: str) -> Column:
    """Turns of the objects in an array; what isn't text in them is its JSON."""
    found = F.try_variant_get("v", path, "array<variant>")
    return F.transform(found, lambda m: F.struct(F.try_variant_get(m, f"$.{role}", "string").alias("role"), F.try_variant_get(m, f"$.{text}", "string").alias("text")))


def _speaker(turns: Column) -> Column:
    known = lambda r: F.when(r.isin("human", "prompter"), "user").when(r.isin("gpt", "bot", "model"), ASSISTANT).otherwise(r)
    return F.transform(turns, lambda m: F.struct(known(m["role"]).alias("role"), m["text"].alias("text")))


def _asked(instruction: str, more: str) -> Column:
    extra = F.coalesce(_text(more), F.lit(""))
    return F.when(extra == "", _text(instruction)).otherwise(F.concat_ws("\n\n", _text(instruction), extra))


# The field paths of each known layout of a record and what makes turns of it.
LAYOUTS: dict[str, tuple[tuple[str, ...], Callable[[], Column]]] = {
    "messages": (("messages", "messages[].content", "messages[].role"), lambda: _speaker(_listed("$.messages", "role", "content"))),
    "conversations": (("conversations", "conversations[].from", "conversations[].value"), lambda: _speaker(_listed("$.conversations", "from", "value"))),
    "system_prompt_response": (("prompt", "response", "system"), lambda: F.array(_turn("system", _text("$.system")), _turn("user", _text("$.prompt")), _turn(ASSISTANT, _text("$.response")))),
    "instruction_input_output": (("input", "instruction", "output"), lambda: F.array(_turn("user", _asked("$.instruction", "$.input")), _turn(ASSISTANT, _text("$.output")))),
    "prompt_response": (("prompt", "response"), lambda: F.array(_turn("user", _text("$.prompt")), _turn(ASSISTANT, _text("$.response")))),
    "prompt_completion": (("completion", "prompt"), lambda: F.array(_turn("user", _text("$.prompt")), _turn(ASSISTANT, _text("$.completion")))),
    "instruction_output": (("instruction", "output"), lambda: F.array(_turn("user", _text("$.instruction")), _turn(ASSISTANT, _text("$.output")))),
}

# Typed tables of one row a turn, as conversation, order, role and text.
ROW_LAYOUTS: dict[str, tuple[str, ...]] = {
    "conv_id": ("conv_id", "turn", "role", "text"),
    "conversation_id": ("conversation_id", "index", "role", "content"),
    "id": ("id", "position", "from", "value"),
}


def print_of(paths) -> int:
    """The fingerprint of a set of field paths: XXH64 with seed 42 of the sorted paths, one a line, as a signed long."""
    from xxhash import xxh64_intdigest

    found = xxh64_intdigest("\n".join(sorted(paths)).encode(), seed=42)
    return found - (1 << 64) if found >> 63 else found


def registry(layouts: dict[str, tuple[str, ...]]) -> dict[str, tuple[list[str], int]]:
    """The sorted paths that each layout asks for and their fingerprint, in the order in which layouts are tried."""
    return {name: (sorted(paths), print_of(paths)) for name, paths in layouts.items()}


def layout_of(paths: set[str], layouts: dict[str, tuple[str, ...]]) -> str | None:
    """The first layout whose fingerprint the paths have."""
    return next((name for name, (own, mark) in registry(layouts).items() if print_of(paths.intersection(own)) == mark), None)


def _record_paths(v: Column, known: list[str]) -> Column:
    """The sorted known paths of a variant: fields, and fields of the objects in its arrays."""
    fields = lambda x, path: F.coalesce(F.map_keys(F.try_variant_get(x, path, "map<string,variant>")), F.array().cast("array<string>"))
    found = fields(v, "$")
    for name in sorted({p.split("[]")[0] for p in known if "[]" in p}):
        items = F.coalesce(F.try_variant_get(v, f"$.{name}", "array<variant>"), F.array().cast("array<variant>"))
        prefix = F.lit(f"{name}[].")
        names = F.flatten(F.transform(items, lambda m: fields(m, "$")))
        found = F.concat(found, F.transform(names, lambda k: F.concat(prefix, k)))  # noqa: B023  used at once
    return F.array_sort(F.array_intersect(found, F.lit(known)))


def _read(records: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """Records as variants, with their known field paths and the layout that they have."""
    known = registry({n: paths for n, (paths, _) in LAYOUTS.items()})
    rows = records.select(F.col(id_col).alias("conv_id"), F.col(json_col).cast("string").alias("record"), F.try_parse_json(F.col(json_col).cast("string")).alias("v"))
    rows = rows.withColumn("paths", _record_paths(F.col("v"), sorted({p for paths, _ in known.values() for p in paths})))
    layout = F.coalesce(*[F.when(F.xxhash64(F.array_join(F.array_intersect("paths", F.lit(paths)), "\n")) == mark, name) for name, (paths, mark) in known.items()])
    return rows.withColumn("layout", layout)


def turns_of_records(records: DataFrame, id_col: str = "conv_id", json_col: str = "record") -> DataFrame:
    """Canonical turns (``conv_id``, ``turn``, ``role``, ``text``) of JSON records of any known layouts; those without turns are in :func:`rejected_records`."""
    turns = F.coalesce(*[F.when(F.col("layout") == name, make()) for name, (_, make) in LAYOUTS.items()])
    return _read(records, id_col, json_col).select("conv_id", F.posexplode(turns).alias("turn", "m")).select("conv_id", F.col("turn").cast("long").alias("turn"), "m.role", "m.text")


def rejected_records(records: DataFrame, id_col: str = "conv_id", json_col: str = "record") -> DataFrame:
    """(``conv_id``, ``record``, ``reason``) of the records that have no turns and why (empty lists are no known layout)."""
    rows = _read(records, id_col, json_col)
    reason = F.when(F.col("record").isNull(), "null")
    reason = reason.when(F.col("v").isNull(), F.when(F.get_json_object("record", "$").isNull(), "not JSON").otherwise("a key comes twice"))
    reason = reason.when(~F.schema_of_variant("v").startswith("OBJECT"), "not an object")
    reason = reason.when(F.col("layout").isNull(), F.when(F.size("paths") == 0, "no known field").otherwise(F.concat(F.lit("no mapping for the fields "), F.array_join("paths", ", "))))
    return rows.select("conv_id", "record", reason.alias("reason")).where(F.col("reason").isNotNull())


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Nested field paths of a schema."""
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{at}[]")
    if isinstance(kind, T.StructType):
        return [p for f in kind for name in [f"{at}.{f.name}".lstrip(".")] for p in [name, *field_paths(f.dataType, name)]]
    return []


def turns_of_table(table: DataFrame, id_col: str | None = None) -> DataFrame:
    """Canonical turns of a typed table, by the fingerprint of its schema: rows by turn, or one record a row.

    The conversation of a record is ``id_col``, or else the first column that its layout doesn't use.
    """
    paths = set(field_paths(table.schema))
    name = layout_of(paths, ROW_LAYOUTS)
    if name:
        return table.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(ROW_LAYOUTS[name], ("conv_id", "turn", "role", "text"), strict=True)])
    name = layout_of(paths, {n: p for n, (p, _) in LAYOUTS.items()})
    tops = sorted({p.split("[]")[0] for p in LAYOUTS[name][0]}) if name else []
    rest = [id_col] if id_col else [c for c in table.columns if c not in tops]
    if not name or not rest:
        raise ValueError(f"no mapping for a table with the fields {sorted(paths)}")
    record = F.to_json(F.struct(*tops), {"ignoreNullFields": "false"})
    return turns_of_records(table.select(F.col(f"`{rest[0]}`").alias("conv_id"), record.alias("record")))


def escape(text: Column) -> Column:
    for plain, mark in (("\\", "\\\\"), ("###", "\\h"), ("</turn>", "\\t")):
        text = F.replace(text, F.lit(plain), F.lit(mark))
    return text


def unescape(text: Column) -> Column:
    """Undo :func:`escape`: between pairs of backslashes, a backslash begins a mark."""
    def plain(part: Column) -> Column:
        for mark, what in (("\\h", "###"), ("\\t", "</turn>"), ("\\c", ":")):
            part = F.replace(part, F.lit(mark), F.lit(what))
        return part
    return F.array_join(F.transform(F.split(text, re.escape("\\\\")), plain), "\\")


def format_turns(turns: DataFrame) -> DataFrame:
    """(``conv_id``, ``formatted``, ``loss_spans array<struct<start,end>>``) of canonical turns."""
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    # escaped after the shuffle, which the order by plain texts needs
    head, body = F.concat(F.lit("### "), F.replace(escape(F.col("role")), F.lit(":"), F.lit("\\c")), F.lit(": ")), escape(F.col("text"))
    size = (F.char_length(head) + F.char_length(body) + len(TURN_END)).cast("long")
    ordered = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("place", F.row_number().over(ordered)).withColumn("before", F.coalesce(F.sum(size).over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    start = F.col("before") + F.char_length(head)
    piece = F.struct("place", F.concat(head, body, F.lit(TURN_END)).alias("piece"), (F.col("role") == ASSISTANT).alias("loss"), start.alias("start"), (start + F.char_length(body)).alias("end"))
    out = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(piece)).alias("pieces"))
    spans = F.transform(F.filter("pieces", lambda p: p["loss"]), lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end")))
    return out.select("conv_id", F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"), spans.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns (``role``, ``text``) back from a formatted text."""
    pieces = F.filter(F.split(formatted, re.escape(TURN_END)), lambda p: p != "")
    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, ": ", 1)
        body = F.substring(piece, F.char_length(role) + 3, F.char_length(piece))
        return F.struct(unescape(F.substring(role, F.lit(5), F.char_length(role))).alias("role"), unescape(body).alias("text"))
    return F.transform(pieces, turn)


def digest(formatted: DataFrame) -> DataFrame:
    """Figures and digests, all read back from the formatted text and its loss spans."""
    turns = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    rows = formatted.withColumn("turns", read_turns(F.col("formatted"))).withColumn("loss", F.array_join(loss, ""))
    return rows.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"),
                       F.sha2("loss", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))
