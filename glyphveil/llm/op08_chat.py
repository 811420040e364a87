"""Chat formatting, with DataFrame operations alone: schema fingerprints choose declarative layouts.

A record is a JSON object in one of many layouts. Those of its nested field paths that any layout
knows are hashed to a fingerprint; the fingerprint selects a declarative layout, which says where roles
and texts lie, and gives canonical turns. Fields that no layout knows don't matter. A template marks turns; control strings inside texts are broken
by a backslash that can be taken out again, so the output can be read back exactly.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Places before which a text gets a backslash: in front of a backslash, and after the first sign of a control string.
_BREAKS = r"(?=\\)|(?<=<)(?=\|)|(?<=\[)(?=/?INST\])|(?<=<)(?=/?s>)|(?<=<)(?=</?SYS>>)"
_TURNS = "array<struct<role: string, text: string>>"


@dataclass(frozen=True)
class Layout:
    """Where the turns of a layout lie.

    fixed: (role, field) of each turn, in order, for flat layouts; or many: (field, role's name,
    text's name) for a list. first: (role, field) of turns before those, which a record may lack.
    ignored: known paths that don't matter here. roles: other names of roles.
    """

    name: str
    fixed: tuple[tuple[str, str], ...] = ()
    many: tuple[str, str, str] | None = None
    first: tuple[tuple[str, str], ...] = ()
    ignored: tuple[str, ...] = ()
    roles: dict[str, str] = field(default_factory=dict)

    @property
    def needed(self) -> set[str]:
        return {path for _, path in self.fixed} | ({f"{self.many[0]}[]"} if self.many else set())

    @property
    def spare(self) -> set[str]:
        """Paths that may be there or not; of a list's elements any, as it may be empty."""
        return {path for _, path in self.first} | set(self.ignored) | ({f"{self.many[0]}[].{x}" for x in self.many[1:]} if self.many else set())


_SYSTEM = (("system", "system"),)
LAYOUTS = (
    Layout("prompt", fixed=(("user", "prompt"), ("assistant", "completion")), first=_SYSTEM),
    Layout("prompt_response", fixed=(("user", "prompt"), ("assistant", "response")), first=_SYSTEM),
    Layout("question", fixed=(("user", "question"), ("assistant", "answer")), first=_SYSTEM),
    Layout("instruction", fixed=(("user", "instruction"), ("assistant", "output")), first=_SYSTEM),
    Layout("instruction_input", fixed=(("user", "instruction"), ("user", "input"), ("assistant", "output")), first=_SYSTEM),
    Layout("messages", many=("messages", "role", "content"), ignored=("prompt",)),
    Layout("shared", many=("conversations", "from", "value"), first=_SYSTEM, roles={"human": "user", "gpt": "assistant"}),
)


def known_paths(record: Column, layouts: Sequence[Layout]) -> Column:
    """The paths of a JSON object that layouts know, sorted; null if it is none. Of a list `name[]`, and `name[].field` for each field of its elements."""
    known = sorted({p for x in layouts for p in x.needed | x.spare})
    v = F.try_parse_json(record)
    top = F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
    out = F.filter(top, lambda k: k.isin([p for p in known if "[]" not in p]))
    for name in sorted({x.many[0] for x in layouts if x.many}):
        listed = F.try_variant_get(v, f"$.{name}", "array<variant>")
        # A list is one of turns only if its elements are objects or null.
        listed = F.when(F.forall(listed, lambda e: F.is_variant_null(e) | F.try_variant_get(e, "$", "map<string,variant>").isNotNull()), listed)
        keys = F.flatten(F.transform(listed, lambda e: F.coalesce(F.map_keys(F.try_variant_get(e, "$", "map<string,variant>")), F.array().cast("array<string>"))))
        paths = F.concat(F.array(F.lit(f"{name}[]")), F.transform(keys, lambda k: F.concat(F.lit(f"{name}[]."), k)))
        out = F.concat(out, F.when(listed.isNotNull(), F.filter(paths, lambda k: k.isin(known))).otherwise(F.array().cast("array<string>")))
    return F.array_sort(F.array_distinct(out))


def fingerprint(paths: Column) -> Column:
    return F.xxhash64(F.array_join(paths, "\n"))


def _fingerprints(x: Layout) -> Column:
    """Those of all path sets that a layout takes."""
    spare = sorted(x.spare)
    sets = [sorted(x.needed | {p for i, p in enumerate(spare) if k >> i & 1}) for k in range(1 << len(spare))]
    return F.array(*[fingerprint(F.array(*[F.lit(p) for p in s])) for s in sets])


def _mapped(turns: Column, names: Column) -> Column:
    return F.transform(turns, lambda t: F.struct(F.coalesce(names[t["role"]], t["role"]).alias("role"), t["text"].alias("text")))


def canonical_turns(df: DataFrame, record: str = "record", layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """df with fingerprint (long), layout (string), turns (array of role, text) and reason (string).

    A record of no known layout, or that isn't a JSON object, has null layout and turns, and a reason;
    others have none. A missing role or text is empty, a value that isn't text is taken as JSON has it;
    an empty list has no turns. Of several layouts that take a record the first holds. Columns so
    named are replaced, others stay.
    """
    paths = known_paths(F.col(record), layouts)
    df = df.withColumn("fingerprint", fingerprint(paths))
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(_TURNS)
    v = F.try_parse_json(F.col(record))
    said = lambda role, path: F.struct(F.lit(role).alias("role"), F.try_variant_get(v, f"$.{path}", "string").alias("text"))
    for x in reversed(layouts):
        here = F.array_contains(_fingerprints(x), F.col("fingerprint"))
        name = F.when(here, F.lit(x.name)).otherwise(name)
        if x.many:
            listed, role, text = x.many
            maps = F.try_variant_get(v, f"$.{listed}", "array<map<string,variant>>")
            word = lambda m, k: F.try_variant_get(F.element_at(m, k), "$", "string")
            got = F.transform(maps, lambda m: F.struct(word(m, role).alias("role"), word(m, text).alias("text")))  # noqa: B023
        else:
            got = F.array(*[said(role, path) for role, path in x.fixed])
        for role, path in reversed(x.first):
            got = F.when(F.array_contains(paths, path), F.concat(F.array(said(role, path)), got)).otherwise(got)
        if x.roles:
            got = _mapped(got, F.create_map(*[F.lit(s) for pair in x.roles.items() for s in pair]))
        turns = F.when(here, got).otherwise(turns)
    filled = F.transform(F.col("turns"), lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))
    reason = F.when(paths.isNull(), F.lit("not a JSON object")).when(name.isNull(), F.lit("unknown layout"))
    return df.withColumn("layout", name).withColumn("reason", reason).withColumn("turns", turns).withColumn("turns", filled)


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _BREAKS, r"\\")


def unescaped(text: Column) -> Column:
    """What escaped() was given: a backslash goes, the sign after it stays."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _role_line(role: Column) -> Column:
    """A role with control strings and line ends broken, so that the first bare line end ends it."""
    return F.regexp_replace(escaped(role), r"(?=\n)", r"\\")


def _in_parts(of: Column) -> Column:
    """An array cut into parts of about the square root of its size, so that work within a part, and over the parts, is small."""
    k = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(of))).cast("int"))
    return F.when(F.size(of) > 0, F.transform(F.sequence(F.lit(0), F.ceil(F.size(of) / k).cast("int") - 1), lambda b: F.slice(of, b * k + 1, k))).otherwise(F.array().cast("array<array<struct<start: int, size: int>>>"))


def _running(sizes: Column, begin: Column) -> Column:
    """begin, and begin with the sums of the first one, two and more sizes added: as many as there are sizes."""
    start = F.struct(begin.alias("at"), F.array().cast("array<int>").alias("all"))
    return F.aggregate(sizes, start, lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["all"], F.array(a["at"])).alias("all")))["all"]


def _placed(lengths: Column) -> Column:
    """Of (start within a turn, size), with the whole turn's length as start of the next, the places in the joined text.

    lengths: an array of struct(start, size): size is the length of a turn, start where its text begins
    in it. The running sum is taken over parts and then within each, so it costs little more than
    linear time.
    """
    parts = _in_parts(lengths)
    sums = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda a, x: a + x["size"]))
    begins = _running(sums, F.lit(0))

    def within(p: Column, begin: Column) -> Column:
        at = _running(F.transform(p, lambda x: x["size"]), begin)
        return F.zip_with(p, at, lambda x, a: x["start"] + a)

    return F.flatten(F.zip_with(parts, begins, within))


def format_chat(df: DataFrame, learn: str = "assistant") -> DataFrame:
    """df with formatted (string) and loss_spans (array of start, size in code points, one for each turn of role learn), from turns.

    Null turns give null. The spans cover the texts as they stand in formatted, without marks.
    """
    parts = F.transform("turns", lambda t: F.struct((t["role"] == learn).alias("learn"), F.concat(F.lit(OPEN), _role_line(t["role"]), F.lit("\n")).alias("head"), escaped(t["text"]).alias("body")))
    df = df.withColumn("__gv_parts", parts)
    joined = F.array_join(F.transform("__gv_parts", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "")
    lengths = F.transform("__gv_parts", lambda p: F.struct(F.length(p["head"]).alias("start"), (F.length(p["head"]) + F.length(p["body"]) + len(CLOSE)).alias("size")))
    placed = F.zip_with("__gv_parts", _placed(lengths), lambda p, at: F.struct(p["learn"].alias("learn"), at.alias("start"), F.length(p["body"]).alias("size")))
    spans = F.transform(F.filter(placed, lambda p: p["learn"]), lambda p: F.struct(p["start"].alias("start"), p["size"].alias("size")))
    return df.withColumn("formatted", joined).withColumn("loss_spans", spans).drop("__gv_parts")


def _cut(text: Column, spans: Column) -> Column:
    """The pieces of text in spans (start, size), which rise; part by part, so that no piece is sought from the text's start."""

    def pieces(p: Column) -> Column:
        begin, last = p[0]["start"], F.element_at(p, -1)
        whole = F.array(F.substring(text, begin + 1, last["start"] + last["size"] - begin))
        return F.flatten(F.transform(whole, lambda w: F.transform(p, lambda x: F.substring(w, x["start"] - begin + 1, x["size"]))))

    return F.flatten(F.transform(_in_parts(spans), pieces))


def read_back(df: DataFrame) -> DataFrame:
    """df with turns and loss_text from formatted and loss_spans alone."""
    pieces = F.filter(F.split("formatted", r"<\|im_end\|>\n", -1), lambda x: x != "")
    body = F.transform(pieces, lambda x: F.regexp_replace(x, r"^<\|im_start\|>", ""))
    # The head ends at the first line end without a backslash before it.
    head = r"(?s)^((?:[^\\\n]|\\.)*+)\n(.*)$"
    turns = F.transform(body, lambda x: F.struct(unescaped(F.regexp_extract(x, head, 1)).alias("role"), unescaped(F.regexp_extract(x, head, 2)).alias("text")))
    loss = F.array_join(_cut(F.col("formatted"), F.col("loss_spans")), "")
    return df.withColumn("turns", turns).withColumn("loss_text", unescaped(loss))


def digests(df: DataFrame) -> DataFrame:
    """n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of turns, loss_text and formatted."""
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return df.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def records(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as one JSON record a conversation, in the layout that its roles allow.

    Turns go by number, ties by role and text. User and assistant alone become prompts, instructions
    or questions by conv_id; with a system turn first, an instruction; conversations of the three
    known roles alternate between two list layouts; other roles keep their names in messages.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    convs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    convs = convs.withColumn("roles", F.transform("t", lambda x: x["role"])).withColumn("k", F.coalesce(F.pmod(F.col("conv_id"), F.lit(4)), F.lit(0)))
    is_ = lambda *names: F.col("roles") == F.array(*[F.lit(n) for n in names])
    say = lambda i: F.col("t")[i]["text"]
    known = F.forall("roles", lambda r: r.isin("system", "user", "assistant"))
    pair, three = is_("user", "assistant"), is_("system", "user", "assistant")
    other = {"user": "human", "assistant": "gpt"}
    shared = F.transform("t", lambda x: F.struct(F.coalesce(F.create_map(*[F.lit(s) for p in other.items() for s in p])[x["role"]], x["role"]).alias("from"), x["text"].alias("value")))
    messages = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))
    record = (
        F.when(pair & (F.col("k") == 0), F.to_json(F.struct(say(0).alias("prompt"), say(1).alias("completion"))))
        .when(pair & (F.col("k") == 1), F.to_json(F.struct(say(0).alias("instruction"), say(1).alias("output"))))
        .when(pair & (F.col("k") == 2), F.to_json(F.struct(say(0).alias("question"), say(1).alias("answer"))))
        .when(three & (F.col("k") < 2), F.to_json(F.struct(say(0).alias("system"), say(1).alias("instruction"), say(2).alias("output"))))
        .when(known & (F.col("k") % 2 == 1), F.to_json(F.struct(shared.alias("conversations"))))
        .otherwise(F.to_json(F.struct(messages.alias("messages"))))
    )
    return convs.select("conv_id", record.alias("record"))


def _sql() -> str:
    marks = ["\\", "<|", "[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>"]
    grown = lambda c: " + ".join([f"length({c})"] + [f"(length({c}) - length(replace({c}, '{m}', ''))) // {len(m)}" for m in marks])
    lines = f" + length(role) - length(replace(role, chr(10), ''))"
    return f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
  coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss,
  sum({len(OPEN) + 1 + len(CLOSE)} + {grown('role')}{lines} + {grown('text')})::BIGINT AS formatted_chars FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""


SQL = _sql()
