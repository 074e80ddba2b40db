"""Chat formatting: schema fingerprints choose declarative mappings to canonical turns.

A record is a JSON text of unknown layout.  Its nested field paths, of those
that any mapping names, are hashed; the hash selects the mapping that
says where turns are.  Other fields (ids, names, scores) don't change the
fingerprint.  A record that no mapping fits keeps its whole text as one turn
of the role ``unknown``, and has a null layout, so that it can be found.
Turns are rendered by a template with markers;
control strings inside texts are escaped reversibly, and the loss mask is a list
of spans (in code points) of the assistants' texts in the output.

All of it is DataFrame expressions.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
# Control strings of this template and of common public ones.
CONTROL = (
    "<|turn|>", "<|text|>", "<|end|>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|begin_of_text|>", "<|end_of_text|>",
    "<|start_header_id|>", "<|end_header_id|>", "<|eot_id|>", "<|system|>", "<|user|>", "<|assistant|>", "<s>", "</s>",
    "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<start_of_turn>", "<end_of_turn>", "<bos>", "<eos>", "<pad>", "<unk>",
)

#: Roles in layouts that call them otherwise.
SHARE_ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
UNKNOWN = "unknown"


class Layout:
    """One mapping: the sets of field paths that it fits, and where turns are.

    Either ``items`` names an array of objects with a role and a text field, whose
    roles may be renamed, or ``fields`` lists (role, names); texts of several names are joined by an
    empty line, absent and empty ones left out, and a system role without text gives no turn.
    """

    def __init__(
        self, name: str, fits: list[list[str]], items: tuple[str, str, str] | None = None,
        fields: list[tuple[str, tuple[str, ...]]] | None = None, roles: dict[str, str] | None = None,
    ):
        self.name, self.fits, self.items, self.fields, self.roles = name, fits, items, fields, roles

    def prints(self) -> list[str]:
        return [hashlib.sha256("\n".join(sorted(p)).encode()).hexdigest() for p in self.fits]

    def turns(self, record: Column) -> Column:
        if self.items:
            at, role, text = self.items
            kind = f"array<struct<`{role}`: string, `{text}`: string>>"
            found = F.coalesce(F.from_json(record, f"struct<`{at}`: {kind}>")[at], F.array().cast(kind))

            def turn(t: Column) -> Column:
                name = t[role]
                if self.roles:
                    name = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in self.roles.items() for x in kv]), name), name)
                return F.struct(F.coalesce(name, F.lit("")).alias("role"), F.coalesce(t[text], F.lit("")).alias("text"))

            return F.transform(found, turn)
        names = [n for _, ns in self.fields for n in ns]
        parsed = F.from_json(record, "struct<" + ", ".join(f"`{n}`: string" for n in names) + ">")
        each = [
            F.struct(F.lit(role).alias("role"), F.concat_ws("\n\n", *[F.when(parsed[n] != "", parsed[n]) for n in ns]).alias("text"))
            for role, ns in self.fields
        ]
        return F.filter(F.array(*each), lambda t: (t["text"] != "") | (t["role"] != "system"))


LAYOUTS = (
    Layout("messages", [["messages", "messages[].role", "messages[].content"], ["messages"]], items=("messages", "role", "content")),
    Layout("share", [["conversations", "conversations[].from", "conversations[].value"], ["conversations"]], items=("conversations", "from", "value"), roles=SHARE_ROLES),
    Layout("instruction", [["instruction", "input", "output"], ["instruction", "output"]], fields=[("user", ("instruction", "input")), ("assistant", ("output",))]),
    Layout("prompt", [["prompt", "response"], ["system", "prompt", "response"]], fields=[("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))]),
    Layout("completion", [["prompt", "completion"], ["system", "prompt", "completion"]], fields=[("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",))]),
    Layout("question", [["question", "answer"]], fields=[("user", ("question",)), ("assistant", ("answer",))]),
)


def field_paths(record: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """Sorted paths of a JSON object, of those that the layouts name; null if it isn't one.

    ``a[].b``: field b of any element of the list a; ``a[].?``: what should be a list of objects is something else.
    """
    known = sorted({p for x in layouts for fit in x.fits for p in fit})
    top = F.array_intersect(F.json_object_keys(record), F.array(*[F.lit(p) for p in known if "[]" not in p]))

    def fields_of(at: str) -> Column:
        inner = F.from_json(record, f"struct<`{at}`: array<map<string, string>>>")[at]
        keys = F.flatten(F.transform(inner, lambda m: F.coalesce(F.map_keys(m), F.array(F.lit("?")))))
        paths = F.coalesce(F.transform(keys, lambda k: F.concat(F.lit(f"{at}[]."), k)), F.array(F.lit(f"{at}[].?")))
        wanted = F.array(*[F.lit(p) for p in known if p.startswith(f"{at}[].")], F.lit(f"{at}[].?"))
        return F.when(F.array_contains(top, at), F.array_intersect(paths, wanted)).otherwise(F.array().cast("array<string>"))

    return F.sort_array(F.concat(top, *[fields_of(at) for at in sorted({p.split("[].")[0] for p in known if "[]" in p})]))


def fingerprint(record: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    return F.sha2(F.when(field_paths(record, layouts).isNotNull(), F.concat_ws("\n", field_paths(record, layouts))), 256)


def canonical(df: DataFrame, record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Adds ``fingerprint, layout`` (null if none fits) and ``turns``.

    A record that isn't a JSON object has no fingerprint.  A record without a
    layout keeps its text as one turn of the role ``unknown``, which no loss mask takes; a null one
    has no turns.  Null roles and texts become empty.  Columns of these names are replaced.
    """
    out = df.withColumn("fingerprint", fingerprint(F.col(record), layouts))
    kept = F.array(F.struct(F.lit(UNKNOWN).alias("role"), F.col(record).alias("text")))
    layout = F.lit(None).cast("string")
    turns = F.when(F.col(record).isNull(), F.array().cast("array<struct<role: string, text: string>>")).otherwise(kept)
    for x in reversed(layouts):
        fits = F.col("fingerprint").isin(*x.prints())
        layout, turns = F.when(fits, F.lit(x.name)).otherwise(layout), F.when(fits, x.turns(F.col(record))).otherwise(turns)
    return out.withColumn("layout", layout).withColumn("turns", turns)


def unknown_layouts(df: DataFrame) -> DataFrame:
    """``fingerprint, paths, n`` of the canonical records that no layout fits: what a new mapping is needed for."""
    left = df.filter(F.col("layout").isNull() & F.col("record").isNotNull())
    return left.groupBy("fingerprint", F.concat_ws(",", F.sort_array(F.json_object_keys("record"))).alias("paths")).agg(F.count(F.lit(1)).alias("n"))


def escape(text: Column) -> Column:
    """Backslashes are doubled, and one is put after the first character of each control string."""
    heads = {c[0] for c in CONTROL}
    quoted = "|".join(rf"\Q{c[1:]}\E" for c in CONTROL)
    assert all("\\" not in c for c in CONTROL)
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), rf"([{''.join(sorted(chr(92) + h for h in heads))}])(?={quoted})", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def render(df: DataFrame, turns: str = "turns", loss_role: str = "assistant") -> DataFrame:
    """Adds ``formatted`` and ``loss_spans`` (array of start, length; code points from 0)."""
    safe = F.transform(F.col(turns), lambda t: F.struct(escape(t["role"]).alias("role"), escape(t["text"]).alias("text"), (t["role"] == loss_role).alias("loss")))
    fixed, tail = len(TURN) + len(TEXT), len(END)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, length: int>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + fixed + F.char_length(t["role"])
        length = F.char_length(t["text"])
        span = F.array(F.struct(start.cast("int").alias("start"), length.cast("int").alias("length")))
        return F.struct(
            (start + length + tail).cast("int").alias("at"),
            F.when(t["loss"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"),
        )

    return (
        df.withColumn("__safe", safe)
        .withColumn("formatted", F.concat_ws("", F.transform("__safe", lambda t: F.concat(F.lit(TURN), t["role"], F.lit(TEXT), t["text"], F.lit(END)))))
        .withColumn("loss_spans", F.aggregate("__safe", zero, step, lambda acc: acc["spans"]))
        .drop("__safe")
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a rendered text."""
    parts = F.split(formatted, rf"\Q{TURN}\E", -1)
    rest = lambda p: F.substr(p, F.instr(p, TEXT) + len(TEXT))
    return F.transform(
        F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))),
        lambda p: F.struct(
            unescape(F.substring_index(p, TEXT, 1)).alias("role"),
            unescape(F.left(rest(p), F.char_length(rest(p)) - len(END))).alias("text"),
        ),
    )


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the mask, unescaped, as one string."""
    return F.concat_ws("", F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["length"]))))


def records(conversations: DataFrame) -> DataFrame:
    """``conv_id, record``: one JSON record of messages for each conversation.

    Rows in the order of turn, those with equal turns by role and text; null texts and roles are empty.
    """
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    packed = F.transform(F.array_sort(F.collect_list(row)), lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))
    return conversations.groupBy("conv_id").agg(F.to_json(F.struct(packed.alias("messages"))).alias("record"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(
        F.lit(-1).cast("bigint").alias("conv_id"), F.to_json(F.struct(F.lit(text).alias("prompt"), F.lit(text).alias("response"))).alias("record")
    )
    found = render(canonical(records(table(spark, sf_dir, "conversations")).unionByName(extra)))
    back = found.select("conv_id", "layout", "formatted", read_turns(F.col("formatted")).alias("t"), read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    return back.select(
        "conv_id",
        F.size("t").cast("bigint").alias("n_turns"),
        F.sha2(F.concat_ws("", F.transform("t", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))), 256).alias("turns_sha256"),
        F.char_length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )


def _escaped_sql(c: str) -> str:
    out = f"replace({c}, '\\', '\\\\')"
    for x in CONTROL:
        out = f"replace({out}, '{x}', '{x[0]}\\{x[1:]}')"
    return out


ORACLE_SQL = {
    "op2_chat": f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum({len(TURN) + len(TEXT) + len(END)} + length({_escaped_sql("role")}) + length({_escaped_sql("text")})) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id"""
}

QUERIES = {"op2_chat": op2_chat}
