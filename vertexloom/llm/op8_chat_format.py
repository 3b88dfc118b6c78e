"""Chat formatting in budgeted windows.

Prefix sums of the turns' tokens cut a conversation into spans of whole turns: a span takes turns as
long as they fit the budget beside the system turn and the history. Each span is one window: the
conversation's system turn, then the last turns of the span before as far as the history budget goes,
then its own turns. Assistant texts carry the loss mask in the window in which they are new and nowhere
else, so every target is learnt once.

A window is a plain string in which marks stand around every turn. Inside a text the characters that
marks start with are escaped, so no text can forge a mark and all of it is read back as it was.

Prefix sums are made in two steps, within blocks of turns and over the blocks' sums. Where a span that
starts with a turn would end is told by the prefix sums in a stretch of one budget ahead, so every turn
has its successor. Spans are the successors of the first turn: those of doubled distance are found from
those before, so a conversation of very many spans takes a few more joins and is no task's work. All of it
is built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vertexloom.session import cut, table

BUDGET, HISTORY = 1024, 256
#: Turns of a conversation that are summed together.
BLOCK = 256

# Marks around an assistant's turn and around any other, and what stands for a character in texts.
OPEN, CLOSE = "<s>", "</s>"
ASK, ASKED = "[INST]", "[/INST]"
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("[", "\\o"), ("\n", "\\n"))


def escape(text: Column, line: bool = False) -> Column:
    """Text without ``<`` and ``[``, and without line feeds where it must be one line."""
    for plain, coded in ESCAPES[: 4 if line else 3]:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column, line: bool = False) -> Column:
    for plain, coded in reversed(ESCAPES[: 4 if line else 3]):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def turn_tokens(text: Column) -> Column:
    """A turn's tokens as they are budgeted: a quarter of its bytes, and four for its marks."""
    return (F.octet_length(text) + 3 - F.pmod(F.octet_length(text) + 3, F.lit(4))) / 4 + 4


def _placed(turns: DataFrame, tokens: Column | None) -> DataFrame:
    """Turns with their number, the sum of tokens before them and the tokens of the conversation's system turn."""
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        (F.lit(None) if tokens is None else tokens).cast("long").alias("given"),
    )
    counted = F.coalesce("given", turn_tokens(F.col("text")).cast("long"))
    rows = rows.select("conv_id", "turn", "role", "text", counted.alias("tokens"), F.floor(F.col("turn") / BLOCK).alias("block"))
    by_block = Window.partitionBy("conv_id").orderBy("block")
    before = by_block.rowsBetween(Window.unboundedPreceding, -1)
    first = F.struct("turn", "role", "text", "tokens")
    blocks = (
        rows.groupBy("conv_id", "block")
        .agg(F.sum("tokens").alias("t"), F.count("*").alias("n"), F.min(F.struct(F.col("turn").isNotNull(), first.alias("first")))["first"].alias("first"))
        .select(
            F.col("conv_id").alias("c"),
            F.col("block").alias("b"),
            F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t0"),
            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"),
            F.first("first").over(by_block.rowsBetween(Window.unboundedPreceding, 0)).alias("first"),
        )
    )
    within = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    summed = F.sum("tokens").over(within.rowsBetween(Window.unboundedPreceding, 0))
    return (
        rows.join(blocks, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("block").eqNullSafe(F.col("b")))
        .withColumn("n", F.col("n0") + F.row_number().over(within))
        .withColumn("start", F.col("t0") + summed - F.col("tokens"))
        .withColumn("system", F.when(F.col("first.role") == "system", F.col("first.tokens")).otherwise(F.lit(0).cast("long")))
        .select("conv_id", "n", "role", "text", "tokens", "start", "system")
    )


def _successors(placed: DataFrame, budget: int, history: int) -> DataFrame:
    """``(c, m, next)`` of every turn: the one after the span that would start with it, the turns' number plus one at the end.

    A turn looks at those whose tokens start within a budget of its own start, which are in its own
    stretch of a budget's tokens and in the next.
    """
    turns = placed.select("conv_id", "n", "start", "tokens", "system")
    ends = turns.groupBy("conv_id").agg(F.max("n").alias("last"), F.max_by("start", "n").alias("start"), F.max_by("tokens", "n").alias("tokens"))
    ends = ends.select("conv_id", (F.col("last") + 1).alias("n"), (F.col("start") + F.col("tokens")).alias("start"), F.lit(None).cast("long").alias("most"))
    most = F.when(F.col("n") == 1, F.lit(budget)).otherwise(F.lit(budget - history) - F.col("system")).cast("long")
    marks = turns.select("conv_id", "n", "start", most.alias("most")).unionAll(ends)
    stretch = F.floor(F.col("start") / F.lit(max(budget, 1)))
    looked = marks.select("conv_id", "n", "start", "most", stretch.alias("own"), F.explode(F.array(stretch, stretch - 1)).alias("stretch"))
    met = looked.groupBy("conv_id", "stretch").agg(F.collect_list(F.struct("n", "start", "most", (F.col("own") == F.col("stretch")).alias("own"))).alias("all"))

    def following(x: Column) -> Column:
        fits = F.filter("all", lambda y: (y["n"] > x["n"]) & (y["start"] <= x["start"] + x["most"]))
        return F.struct(x["n"].alias("m"), F.aggregate(fits, x["n"] + 1, lambda far, y: F.greatest(far, y["n"])).alias("next"))

    own = F.transform(F.filter("all", lambda x: x["own"] & x["most"].isNotNull()), following)
    return met.select(F.col("conv_id").alias("c"), F.explode(own).alias("x")).select("c", "x.m", "x.next")


def _spans(placed: DataFrame, budget: int, history: int) -> DataFrame:
    """``(c, window, w_end)``: each conversation's spans with their first turn and the one after their last.

    The first span has the whole budget, others what the system turn and the history leave of it.
    """
    follow = cut(_successors(placed, budget, history))
    ends = follow.select(F.col("c").alias("fc"), F.col("m").alias("fm"), "next")
    starts, jump = follow.where("m = 1").select("c", "m"), follow
    while True:
        far = jump.select(F.col("c").alias("jc"), F.col("m").alias("jm"), F.col("next").alias("to"))
        step = starts.join(far, F.col("c").eqNullSafe(F.col("jc")) & (F.col("m") == F.col("jm"))).select("c", F.col("to").alias("m"))
        # What is behind the last turn has no successor and is no start.
        reached = cut(step.join(ends, (F.col("c").eqNullSafe(F.col("fc"))) & (F.col("m") == F.col("fm")), "left_semi"))
        if not reached.limit(1).count():
            break
        starts = cut(starts.unionAll(reached))
        jump = cut(jump.join(far, F.col("c").eqNullSafe(F.col("jc")) & (F.col("next") == F.col("jm"))).select("c", "m", F.col("to").alias("next")))
    own = F.col("c").eqNullSafe(F.col("fc")) & (F.col("m") == F.col("fm"))
    return starts.join(ends, own).select("c", F.col("m").alias("window"), F.col("next").alias("w_end"))


def format_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokens: Column | None = None) -> DataFrame:
    """``(conv_id, window, formatted, loss, n_context)``: the windows of every conversation.

    ``turns`` has conv_id, turn, role, text; other columns are not read, but for those that ``tokens``
    names: a turn's own number of tokens, marks included, for budgets in real tokens; without it, or
    where it is null, ``turn_tokens`` counts (none is below zero). Turns go by ``turn``, null first, ties by role, then text.
    Null roles and texts count as empty; repeated rows are turns of their own; null conv_ids are one
    conversation. A first turn of role ``system`` is repeated in every window and any other role than
    ``assistant`` is never a target. A window's number is that of its first new turn.

    ``loss`` has start and end in ``formatted`` of each new assistant text, in code points. The first
    ``n_context`` turns of a window are repeated. System turn, history and new turns keep to ``budget``
    tokens together, unless the system turn and a single new turn already exceed it: turns are never cut.
    An empty table gives no windows.
    """
    # Written once. What goes where is found without texts; these are moved once they have their windows.
    placed = cut(_placed(turns, tokens))
    lead = (F.col("n") == 1) & (F.col("role") == "system")
    light = placed.select("conv_id", "n", "tokens", "start", "system", lead.alias("lead"))
    spans = _spans(light, budget, history)
    within = spans.select(F.col("c"), "window", F.explode(F.sequence(F.col("window"), F.col("w_end") - 1)).alias("m"))
    light = cut(light.join(within, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("n") == F.col("m"))).drop("c", "m"))
    by_window = Window.partitionBy("conv_id").orderBy("window")
    windows = light.groupBy("conv_id", "window").agg(F.min("start").alias("first"), F.sum("tokens").alias("own"), F.max("system").alias("system"))
    room = F.least(F.lit(history), F.lit(budget) - F.col("system") - F.col("own"))
    windows = windows.select(
        F.col("conv_id").alias("c"),
        F.col("window").alias("w"),
        F.lead("window").over(by_window).alias("next"),
        F.lead(F.col("first") - F.greatest(room, F.lit(0))).over(by_window).alias("from"),
        F.row_number().over(by_window).alias("k"),
    )
    own = light.join(windows, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("window") == F.col("w")))
    again = ~F.col("lead") & (F.col("start") >= F.col("from"))
    new = F.struct(F.col("window").alias("window"), F.lit(False).alias("context"))
    old = F.struct(F.col("next").alias("window"), F.lit(True).alias("context"))
    at = own.select(F.col("conv_id").alias("c"), F.col("n").alias("m"), F.explode(F.when(again, F.array(new, old)).otherwise(F.array(new))).alias("at"))
    at = at.select("c", "m", "at.window", "at.context")
    system = light.where("lead").select("conv_id", F.col("n").alias("m"))
    kept = windows.where("k > 1").join(system, F.col("c").eqNullSafe(F.col("conv_id"))).select("c", "m", F.col("w").alias("window"), F.lit(True).alias("context"))
    shown = placed.select("conv_id", "n", "role", "text").join(at.unionByName(kept), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("n") == F.col("m")))

    answer = F.col("role") == "assistant"
    head = F.concat(F.when(answer, F.lit(OPEN)).otherwise(F.lit(ASK)), escape(F.col("role"), line=True), F.lit("\n"))
    marked = shown.select(
        "conv_id",
        "window",
        F.struct(
            "n",
            head.alias("head"),
            escape(F.col("text")).alias("body"),
            F.when(answer, F.lit(CLOSE)).otherwise(F.lit(ASKED)).alias("tail"),
            (answer & ~F.col("context")).alias("target"),
            "context",
        ).alias("t"),
    )

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.length(t["head"])
        end = start + F.length(t["body"])
        span = F.array(F.struct(start.alias("s"), end.alias("e")))
        return F.struct(
            (end + F.length(t["tail"])).alias("at"),
            F.when(t["target"], F.concat(acc["loss"], span)).otherwise(acc["loss"]).alias("loss"),
        )

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("loss"))
    gathered = marked.groupBy("conv_id", "window").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    return gathered.select(
        "conv_id",
        "window",
        F.array_join(F.transform("ts", lambda t: F.concat(t["head"], t["body"], t["tail"])), "").alias("formatted"),
        F.aggregate("ts", zero, step)["loss"].alias("loss"),
        F.size(F.filter("ts", lambda t: t["context"])).alias("n_context"),
    )


def read_turns(formatted: Column, n_context: Column) -> Column:
    """The new turns of a window as an array of role and text, read from the string alone."""
    parts = F.split(formatted, r"(?=\[INST\]|<s>)", -1)

    def turn(part: Column) -> Column:
        answer = F.startswith(part, F.lit(OPEN))
        left = F.when(answer, F.lit(len(OPEN))).otherwise(F.lit(len(ASK)))
        right = F.when(answer, F.lit(len(CLOSE))).otherwise(F.lit(len(ASKED)))
        inner = F.substring(part, left + 1, F.length(part) - left - right)
        line = F.instr(inner, "\n")
        return F.struct(
            unescape(F.substring(inner, F.lit(1), line - 1), line=True).alias("role"),
            unescape(F.substring(inner, line + 1, F.length(inner))).alias("text"),
        )

    return F.transform(F.slice(parts, n_context + 1, F.size(parts)), turn)


def read_back(windows: DataFrame) -> DataFrame:
    """``(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)`` from windows."""
    parsed = windows.select("conv_id", "window", "formatted", "loss", read_turns(F.col("formatted"), F.col("n_context")).alias("turns"))
    targets = F.transform("loss", lambda x: unescape(F.substring(F.col("formatted"), x["s"] + 1, x["e"] - x["s"])))
    told = parsed.select(
        "conv_id",
        F.struct(
            "window",
            F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"),
            F.array_join(targets, "").alias("loss"),
        ).alias("w"),
        F.size("turns").cast("long").alias("n"),
        F.length("formatted").cast("long").alias("chars"),
    )
    whole = told.groupBy("conv_id").agg(F.array_sort(F.collect_list("w")).alias("ws"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"))
    loss = F.array_join(F.transform("ws", lambda w: w["loss"]), "")
    return whole.select(
        "conv_id",
        "n_turns",
        F.sha2(F.encode(F.array_join(F.transform("ws", lambda w: w["turns"]), ""), "UTF-8"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(F.encode(loss, "UTF-8"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    return read_back(format_windows(turns.unionByName(probe)))


SQL = r"""
with recursive c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t as (
  select *, (strlen(text) + 3) // 4 + 4 as tokens,
    row_number() over (partition by conv_id order by turn nulls first, role, text) as n,
    3 * length(text) - length(replace(text, '\', '')) - length(replace(text, '<', '')) - length(replace(text, '[', '')) + length(text)
    + 4 * length(role) - length(replace(role, '\', '')) - length(replace(role, '<', '')) - length(replace(role, '[', ''))
    - length(replace(role, chr(10), '')) + length(role) + 1 + case when role = 'assistant' then 7 else 13 end as size
  from c),
p as (
  select *, sum(tokens) over (partition by conv_id order by n) - tokens as start, n = 1 and role = 'system' as lead,
    coalesce(sum(tokens) filter (n = 1 and role = 'system') over (partition by conv_id), 0) as system from t),
g as (
  select conv_id, n, tokens, system, n as win, tokens as used from p where n = 1
  union all
  select p.conv_id, p.n, p.tokens, p.system,
    case when more then win else p.n end, case when more then used + p.tokens else p.tokens end
  from (select g.*, g.n + 1 as m,
      g.used + q.tokens <= case when g.win = 1 then 1024 else 1024 - 256 - g.system end as more
    from g join p q on q.conv_id = g.conv_id and q.n = g.n + 1) x join p on p.conv_id = x.conv_id and p.n = x.m),
o as (
  select conv_id, win, first - greatest(least(256, 1024 - system - own), 0) as since
  from (select conv_id, win, min(start) as first, sum(tokens) as own, any_value(system) as system
    from g join (select conv_id, n, start from p) using (conv_id, n) group by conv_id, win)),
w as (select conv_id, win, lead(since) over (partition by conv_id order by win) as next_since from o),
s as (
  select p.*, not lead and start >= next_since as again
  from p join g using (conv_id, n) join w on w.conv_id = p.conv_id and w.win = g.win),
k as (select conv_id, count(*) - 1 as more from w group by conv_id)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by n)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by n) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(size) + coalesce(sum(size) filter (again), 0) + coalesce(sum(size * more) filter (lead), 0) as bigint) as formatted_chars
from s join k using (conv_id) group by conv_id
"""
