"""Chat formatting by schema fingerprints, in DataFrame functions only.

A layout is a set of nested field paths, such as ``messages[].role``. Its fingerprint is the hash of the sorted paths; fields outside
the known vocabulary do not count. The fingerprint selects a declarative mapping (which path is whose turn) that brings prompts,
instructions and message lists into canonical turns, and one template writes those down.

The template marks a turn as ``<|im_start|>role\\ntext<|im_end|>\\n``. In roles and texts each ``<``, any backslashes, ``|`` gets one more
backslash, so no text can open or close a turn and every text can be read back exactly; a role writes its line breaks as ``\\n``.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>\n"


@dataclass(frozen=True)
class Layout:
    """``turns``: (role, path) of single fields in order of speaking. ``each``: (list, role path, text path) of a list of messages.
    ``row``: (position, role, text) of a table with one turn in a row."""

    name: str
    turns: tuple[tuple[str, str], ...] = ()
    each: tuple[str, str, str] | None = None
    row: tuple[str, str, str] | None = None

    @property
    def paths(self) -> frozenset[str]:
        if self.each:
            return frozenset(f"{self.each[0]}[].{c}" for c in self.each[1:])
        return frozenset(self.row or (p for _, p in self.turns))


LAYOUTS = (
    Layout("turn rows", row=("turn", "role", "text")),
    Layout("messages", each=("messages", "role", "content")),
    Layout("conversations", each=("conversations", "from", "value")),
    Layout("prompt and response", turns=(("user", "prompt"), ("assistant", "response"))),
    Layout("prompt and completion", turns=(("user", "prompt"), ("assistant", "completion"))),
    Layout("system, prompt and response", turns=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("question and answer", turns=(("user", "question"), ("assistant", "answer"))),
    Layout("instruction", turns=(("user", "instruction"), ("assistant", "output"))),
    Layout("instruction with input", turns=(("user", "instruction"), ("user", "input"), ("assistant", "output"))),
)
#: Names some layouts give to roles.
ROLE_NAMES = {"human": "user", "gpt": "assistant"}
KNOWN = sorted({p for x in LAYOUTS for p in x.paths})


def fingerprint(paths) -> str:
    """Hash of the sorted paths that the vocabulary knows."""
    return hashlib.sha256("\n".join(sorted(set(paths) & set(KNOWN))).encode()).hexdigest()


BY_PRINT = {fingerprint(x.paths): x for x in LAYOUTS}
BY_SIZE = sorted(LAYOUTS, key=lambda x: -len(x.paths))
#: A field that may stand beside the fields of any layout.
SYSTEM = "system"


def schema_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Nested field paths of a type; ``[]`` stands for the elements of a list."""
    if isinstance(kind, T.StructType):
        return [p for f in kind for p in schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{at}[]")
    return [at]


def _turn(place: Column, role: Column, text: Column) -> Column:
    names = F.create_map(*(F.lit(x) for kv in ROLE_NAMES.items() for x in kv))
    role = F.coalesce(role.cast("string"), F.lit(""))
    return F.struct(place.cast("long").alias("place"), F.coalesce(names[role], role).alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def _prefixed(name: str):
    return lambda key: F.concat(F.lit(f"{name}[]."), key)


def _message(role: str, text: str):
    return lambda m, i: _turn(i, m.getField(role), m.getField(text))


def turns_of(records: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """id, place, role, text of a table whose column types say its layout. Null roles and texts are empty.

    Columns that other layouts also name change the fingerprint; then the layout with the most fields among those present counts. A
    column ``system`` beside any layout but turn rows is a first turn. Raises if there is no layout.
    """
    paths = schema_paths(records.schema)
    layout = BY_PRINT.get(fingerprint(paths)) or next((x for x in BY_SIZE if x.paths <= set(paths)), None)
    if layout is None:
        raise ValueError(f"no mapping for the fields {sorted(paths)}")
    if layout.row:
        found = records.select(F.col(f"`{id_col}`").alias("id"), _turn(*map(F.col, layout.row)).alias("t"))
    elif layout.each:
        items, role, text = layout.each
        found = records.select(F.col(f"`{id_col}`").alias("id"), F.posexplode(items)).select("id", _turn(F.col("pos"), F.col("col").getField(role), F.col("col").getField(text)).alias("t"))
    else:
        parts = [_turn(F.lit(i), F.lit(role), F.col(path)) for i, (role, path) in enumerate(layout.turns)]
        found = records.select(F.col(f"`{id_col}`").alias("id"), F.explode(F.array(*parts)).alias("t"))
    if SYSTEM in paths and not layout.row and SYSTEM not in layout.paths:
        said = records.filter(F.col(SYSTEM).isNotNull())
        found = found.unionByName(said.select(F.col(f"`{id_col}`").alias("id"), _turn(F.lit(-1), F.lit(SYSTEM), F.col(SYSTEM)).alias("t")))
    return found.select("id", "t.*")


def json_turns(records: DataFrame, id_col: str = "conv_id", record_col: str = "record") -> DataFrame:
    """id, fingerprint, layout, place, role, text of JSON records, each with a layout of its own.

    Paths are those of all elements of a list, so a message may lack its role. A record whose fingerprint no layout has takes the
    layout with the most fields among its own; a ``system`` text beside any layout is a first turn, at place -1. A record with the
    fields of no layout, malformed or null, gives one row with a null layout, so that none is lost unseen.
    """
    lists = sorted({x.each[0] for x in LAYOUTS if x.each})
    rows = records.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{record_col}`").alias("record"))
    top = F.coalesce(F.json_object_keys("record"), F.array().cast("array<string>"))
    elements = lambda x: F.coalesce(F.from_json(F.get_json_object("record", f"$.{x}"), "array<map<string,string>>"), F.array().cast("array<map<string,string>>"))
    nested = [F.transform(F.array_distinct(F.flatten(F.transform(elements(x), lambda m: F.coalesce(F.map_keys(m), F.array().cast("array<string>"))))), _prefixed(x)) for x in lists]
    paths = F.array_intersect(F.concat(top, *nested), F.array(*map(F.lit, KNOWN)))
    rows = rows.withColumn("paths", paths).withColumn("fingerprint", F.sha2(F.array_join(F.array_sort("paths"), "\n"), 256))
    prints = F.create_map(*(F.lit(v) for key, x in BY_PRINT.items() for v in (key, x.name)))
    covered = F.coalesce(*(F.when(F.size(F.array_except(F.array(*map(F.lit, sorted(x.paths))), F.col("paths"))) == 0, x.name) for x in BY_SIZE))
    rows = rows.withColumn("name", F.coalesce(prints[F.col("fingerprint")], covered))
    system = F.get_json_object("record", f"$.{SYSTEM}")
    made = F.lit(None).cast("array<struct<place:bigint,role:string,text:string>>")
    for x in LAYOUTS:
        if x.each:
            items = F.from_json(F.get_json_object("record", f"$.{x.each[0]}"), f"array<struct<`{x.each[1]}`:string,`{x.each[2]}`:string>>")
            turns = F.transform(items, _message(x.each[1], x.each[2]))
        elif x.row:
            turns = F.array(_turn(F.get_json_object("record", f"$.{x.row[0]}"), *(F.get_json_object("record", f"$.{c}") for c in x.row[1:])))
        else:
            turns = F.array(*(_turn(F.lit(i), F.lit(role), F.get_json_object("record", f"$.{path}")) for i, (role, path) in enumerate(x.turns)))
        if not x.row and SYSTEM not in x.paths:
            turns = F.when(system.isNotNull(), F.concat(F.array(_turn(F.lit(-1), F.lit(SYSTEM), system)), turns)).otherwise(turns)
        made = F.when(F.col("name") == x.name, turns).otherwise(made)
    return rows.select("id", "fingerprint", F.col("name").alias("layout"), F.explode_outer(made).alias("t")).select("id", "fingerprint", "layout", "t.*")


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def role_written(role: Column) -> Column:
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def role_read(written: Column) -> Column:
    # a doubled backslash is one, a backslash with n a line break: the parts between doubled ones hold no other backslash
    parts = F.split(unescaped(written), r"\\\\")
    return F.array_join(F.transform(parts, lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\")


def formatted(turns: DataFrame, block: int = 256) -> DataFrame:
    """id, n_turns, formatted: the written conversation, turns by place, ties by role and text; repeated rows stay.

    Turns are joined in blocks of ``block`` places first, so a long conversation is sorted in parts; its text is one value in the end.
    """
    written = F.concat(F.lit(START), role_written(F.col("role")), F.lit("\n"), escaped(F.col("text")), F.lit(END))
    rows = turns.withColumn("part", F.floor(F.col("place") / block)).withColumn("t", F.struct("place", "role", "text", written.alias("w")))
    parts = rows.groupBy("id", "part").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list("t")), lambda x: x.getField("w")), "").alias("w"))
    whole = parts.groupBy("id").agg(F.sum("n").alias("n_turns"), F.sort_array(F.collect_list(F.struct("part", "w"))).alias("p"))
    return whole.select("id", "n_turns", F.array_join(F.transform("p", lambda x: x.getField("w")), "").alias("formatted"))


def read_back(written: DataFrame) -> DataFrame:
    """Adds ``turns``: role, text (both as they were given) and loss (whether the text is under the loss mask) of each turn."""
    parts = F.slice(F.split("formatted", r"<\|im_start\|>"), 2, 1 << 30)
    body = lambda x: F.substring(x, F.lit(1), F.char_length(x) - len(END))
    return written.withColumn("turns", F.transform(parts, lambda x: _read_turn(body(x))))


def _read_turn(x: Column) -> Column:
    role = F.substring_index(x, "\n", 1)
    text = F.substring(x, F.char_length(role) + 2, F.char_length(x))
    return F.struct(role_read(role).alias("role"), unescaped(text).alias("text"), (role == "assistant").alias("loss"))


def digests(read: DataFrame) -> DataFrame:
    """id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of conversations read back."""
    said = F.transform("turns", lambda t: F.concat(t.getField("role"), F.lit("\n"), t.getField("text"), F.lit("\n")))
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t.getField("loss")), lambda t: t.getField("text")), "")
    rows = read.select("id", F.size("turns").cast("long").alias("n_turns"), F.array_join(said, "").alias("said"), loss.alias("loss"), F.char_length("formatted").cast("long").alias("formatted_chars"))
    return rows.select("id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
