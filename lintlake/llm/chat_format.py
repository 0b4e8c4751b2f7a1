"""Chat formatting of heterogeneous records, in DataFrame operations only.

A record is a JSON object in one of several layouts. The names of its nested fields, in order and without types, are hashed
to a fingerprint that selects a declarative mapping: expressions that take the canonical turns (role, text) out of
that layout. Turns are then written in one template, which marks turns, escapes control strings inside texts
reversibly, and comes with a loss mask over the assistant's texts. ``read_back`` undoes it.

Template of a turn: ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts a backslash goes behind the first character of
anything that is a control string, or would be one without the backslashes behind its first character; so escaping
never makes two texts equal, and no control string of a text survives.

A JSON reader takes strings of 20 million characters at most, so texts need not be in the record: with a column ``texts`` the record
holds their positions in it (``records_from_turns`` makes such records), and texts of any length pass beside it.

Edge cases: NULL texts and roles are empty. Records of unknown layout, records that are no JSON and those that hold a longer string than the reader takes
are returned by ``unmatched`` (NULL layout and turns), and never guessed at or emptied. A record without turns formats to the empty string. Conversations longer than a row can hold don't fit any output
of one row per conversation; nothing is cut. Rows of one turn number go by role and text, so that ties have one order.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.llm.quality_votes import let

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
# Control strings of this and other templates (fixed values), by first character.
_ESCAPE = [(r"<(\\*)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|<(?:\\*)/?SYS>>)", r"<\\$1$2"), (r"\[(\\*)(/?INST\])", r"[\\$1$2")]
_UNESCAPE = [(r"<\\(\\*)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|<(?:\\*)/?SYS>>)", r"<$1$2"), (r"\[\\(\\*)(/?INST\])", r"[$1$2")]


def escape(text: Column) -> Column:
    for pattern, by in _ESCAPE:
        text = F.regexp_replace(text, pattern, by)
    return text


def unescape(text: Column) -> Column:
    for pattern, by in _UNESCAPE:
        text = F.regexp_replace(text, pattern, by)
    return text


def _role_out(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def _role_in(role: Column) -> Column:
    parts = F.transform(F.split(role, r"\\\\"), lambda p: F.replace(p, F.lit("\\n"), F.lit("\n")))
    return unescape(F.array_join(parts, "\\"))


@dataclass(frozen=True)
class Layout:
    """Field paths that a record has, and where its turns are: (role, JSON path) pairs, or a list with its field names."""

    fields: tuple[str, ...]
    turns: tuple[tuple[str, str], ...] = ()
    messages: tuple[str, str, str] | None = None
    roles: tuple[tuple[str, str], ...] = ()


LAYOUTS = (
    Layout(("prompt", "response"), (("user", "prompt"), ("assistant", "response"))),
    Layout(("input", "instruction", "output"), (("system", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout(("messages", "messages[].content", "messages[].role"), messages=("messages", "role", "content")),
    Layout(("conversations", "conversations[].from", "conversations[].value"), messages=("conversations", "from", "value"),
           roles=(("human", "user"), ("gpt", "assistant"))),
)

_TURN = "array<struct<role:string,text:string>>"


def field_paths(record: Column) -> Column:
    """The sorted paths of all named fields, lists of objects included to a depth of two.

    Lists are read off the record itself, never off the text of a string: an answer may be JSON."""
    names = F.coalesce(F.json_object_keys(record), F.array().cast("array<string>"))

    def below(name: Column) -> Column:
        # NULL unless the value itself is a list that has something in it.
        listed = F.call_function("get_json_object", record, F.concat(F.lit("$['"), name, F.lit("'][*]"))).isNotNull()
        value = F.element_at(F.from_json(record, "map<string,string>"), name)
        items = F.when(listed, F.from_json(value, "array<map<string,string>>"))
        return F.concat(F.array(name), F.transform(F.array_distinct(F.flatten(F.transform(F.coalesce(F.filter(items, lambda m: m.isNotNull()), F.array().cast("array<map<string,string>>")), F.map_keys))), lambda k: F.concat(name, F.lit("[]."), k)))

    return F.array_sort(F.flatten(F.transform(names, below)))


def fingerprint(record: Column) -> Column:
    return F.xxhash64(F.array_join(field_paths(record), "\x00"))


def _mapped(record: Column, layout: Layout, of: Callable[[Column], Column]) -> Column:
    """The turns of a record of this layout; NULL where the reader gives no value for one of its fields."""
    if layout.messages is None:
        names = [name for _, name in layout.turns]
        turns = lambda m: F.array(*[F.struct(F.lit(role).alias("role"), F.coalesce(of(m[name]), F.lit("")).alias("text")) for role, name in layout.turns])
        whole = lambda m: F.size(F.array_intersect(F.map_keys(m), F.array(*map(F.lit, names)))) == len(names)
        return let(F.from_json(record, "map<string,string>"), lambda m: F.when(whole(m), turns(m)))
    items, role, text = layout.messages
    found = F.from_json(F.get_json_object(record, f"$.{items}"), "array<map<string,string>>")
    named = F.create_map(*[F.lit(x) for pair in layout.roles for x in pair]) if layout.roles else None
    to_role = lambda r: F.coalesce(named[r], r, F.lit("")) if layout.roles else F.coalesce(r, F.lit(""))
    turns = F.transform(found, lambda m: F.struct(to_role(m[role]).alias("role"), F.coalesce(of(m[text]), F.lit("")).alias("text")))
    return F.when(~F.exists(found, lambda m: m.isNull()), turns)


def canonical(records: DataFrame, record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS, texts: str | None = None) -> DataFrame:
    """``records`` with ``layout`` (index of the mapping, NULL: none fits) and ``turns``. With ``texts``, an array column, the record's texts are positions in it."""
    of = (lambda v: F.get(F.col(texts), v.cast("int"))) if texts else (lambda v: v)
    print_of = lambda layout: F.xxhash64(F.lit("\x00".join(sorted(layout.fields))))
    marked = records.withColumn("_print", fingerprint(F.col(record)))
    which = F.coalesce(*[F.when(F.col("_print") == print_of(x), F.lit(i)) for i, x in enumerate(layouts)])
    marked = marked.withColumn("layout", which)
    turns = F.coalesce(*[F.when(F.col("layout") == i, _mapped(F.col(record), x, of)) for i, x in enumerate(layouts)])
    out = marked.withColumn("turns", turns.cast(_TURN)).drop("_print")
    return out.withColumn("layout", F.when(F.col("turns").isNotNull(), F.col("layout")))


def unmatched(mapped: DataFrame) -> DataFrame:
    return mapped.filter("layout is null")


def formatted(turns: Column) -> Column:
    """(text, loss): the formatted string, and per span under the loss its turn, start inside the turn's text and length, in
    code points of the formatted (escaped) text."""
    def turn(t: Column, i: Column) -> Column:
        return let(escape(t["text"]), lambda body: let(F.concat(F.lit(OPEN), _role_out(t["role"]), F.lit("\n")), lambda head: F.struct(
            F.concat(head, body, F.lit(CLOSE)).alias("out"),
            F.struct(i.alias("turn"), F.length(head).alias("start"), F.length(body).alias("length"), (t["role"] == "assistant").alias("counts")).alias("span"))))

    return let(F.transform(turns, turn), lambda all_: F.struct(
        F.array_join(F.transform(all_, lambda t: t["out"]), "").alias("text"),
        F.transform(F.filter(all_, lambda t: t["span"]["counts"]), lambda t: t["span"].dropFields("counts")).alias("loss")))


def read_back(text: Column, loss: Column) -> Column:
    """(turns, loss_text): what a formatted string and its mask say."""
    closed = F.split(text, r"<\|im_end\|>\n")
    parts = F.slice(closed, F.lit(1), F.size(closed) - 1)

    def turn(p: Column) -> Column:
        body = F.substring(p, F.lit(len(OPEN) + 1), F.length(p))
        end = F.locate("\n", body)
        return F.struct(_role_in(F.substring(body, F.lit(1), end - 1)).alias("role"), unescape(F.substring(body, end + 1, F.length(body))).alias("text"))

    under = lambda p: F.array_join(F.transform(loss, lambda s: unescape(F.substring(p[s["turn"]], s["start"] + 1, s["length"]))), "")
    return let(parts, lambda p: F.struct(F.transform(p, turn).alias("turns"), under(p).alias("loss_text")))


def digest(turns: Column) -> Column:
    lines = F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return F.sha2(F.array_join(lines, ""), 256)


def records_from_turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, record, texts): the rows of a conversation as one JSON record, in the layout that fits its roles, with the texts beside it."""
    one = F.struct(F.col(turn).alias("n"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    held = rows.groupBy(F.col(conv).alias("conv_id")).agg(F.sort_array(F.collect_list(one)).alias("t"))
    roles = F.array_join(F.transform("t", lambda x: x["role"]), ",")
    as_prompt = F.lit('{"prompt":0,"response":1}')
    as_task = F.lit('{"instruction":0,"input":1,"output":2}')
    as_list = F.to_json(F.struct(F.transform("t", lambda x, i: F.struct(x["role"].alias("role"), i.alias("content"))).alias("messages")))
    record = F.when(roles == "user,assistant", as_prompt).when(roles == "system,user,assistant", as_task).otherwise(as_list)
    return held.select("conv_id", record.alias("record"), F.transform("t", lambda x: x["text"]).alias("texts"))
