"""Chat formatting with Spark expressions only: sorted turn structs, merged runs, one string and a loss mask.

The template: every run of turns of one role is <|start|>ROLE<|text|>TEXT<|next|>TEXT...<|end|> and a line feed.
Inside roles and texts a backslash follows every "<" and "[" and doubles every backslash, so that no text holds a
control string, of this template or of a common other one ("</s>", "[INST]"), and the texts can be read back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

START, TEXT, NEXT, END = "<|start|>", "<|text|>", "<|next|>", "<|end|>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("<\\")), F.lit("["), F.lit("[\\"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\|\\(\\)", "$1$2")


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once a row, however often then and its lambdas use it."""
    return F.get(F.transform(F.array(value), then), 0)


def _indexes(array: Column) -> Column:
    return F.when(F.size(array) > 0, F.sequence(F.lit(0), F.size(array) - 1)).otherwise(F.array().cast("array<int>"))


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: a + x)


def _sums_before(numbers: Column, wanted: Callable[[Column], Column]) -> Column:
    """(start, length) for each place of numbers that is wanted: the sum before it and the number itself.

    Sums of runs of about the square root of their count serve, so nothing grows with the square of the count.
    """

    def spans(run: Column, sums: Column) -> Column:
        def before(i: Column) -> Column:
            j = F.floor(i / run).cast("int")
            return _total(F.slice(sums, F.lit(1), j)) + _total(F.slice(numbers, j * run + 1, i - j * run))

        return F.transform(F.filter(_indexes(numbers), wanted), lambda i: F.struct(before(i).alias("start"), F.get(numbers, i).alias("length")))

    def runs_of(run: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(0), F.floor(F.size(numbers) / run).cast("int")), lambda j: _total(F.slice(numbers, j * run + 1, run)))
        return _let(sums, lambda x: spans(run, x))

    return _let(F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(numbers))).cast("int")), runs_of)


def format_chats(turns: DataFrame, learn: str = "assistant") -> DataFrame:
    """Of (conv_id, turn, role, text) rows: conv_id, formatted, loss_spans.

    loss_spans holds (start, length) in code points of formatted, one for each text of the role to learn, in order;
    a span covers the escaped text and no control string. Turns are sorted by turn (null first), then role and text;
    null roles and texts count as empty; rows without a conv_id are one conversation; repeated rows are turns of
    their own. Adjacent turns of one role are one run, their texts kept apart by <|next|>. An empty table gives an
    empty result; other columns are not read. A conversation is one row of the result, so it must fit into one.
    """
    rows = turns.select("conv_id", F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("turn"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))

    def piece(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def pieces(own: Column, role: Column) -> Column:
        texts = F.transform(own, lambda t, i: F.array(piece(F.when(i > 0, F.lit(NEXT)).otherwise(F.lit("")), F.lit(False)), piece(escape(t["text"]), role == learn)))
        head = piece(F.concat(F.lit(START), escape(role), F.lit(TEXT)), F.lit(False))
        return F.concat(F.array(head), F.flatten(texts), F.array(piece(F.lit(END), F.lit(False))))

    def runs(all_: Column, starts: Column) -> Column:
        """The pieces of each run: the turns from where the role changes to where it changes next."""
        return F.transform(starts, lambda s, k: pieces(F.slice(all_, s + 1, F.coalesce(F.get(starts, k + 1), F.size(all_)) - s), F.get(all_, s)["role"]))

    def changes(all_: Column) -> Column:
        return F.filter(_indexes(all_), lambda i: (i == 0) | (F.get(all_, i)["role"] != F.get(all_, i - 1)["role"]))

    made = _let(F.col("turns"), lambda x: F.flatten(_let(changes(x), lambda starts: runs(x, starts))))

    def result(x: Column) -> Column:
        spans = _let(F.transform(x, lambda p: F.length(p["text"]).cast("long")), lambda n: _sums_before(n, lambda i: F.get(x, i)["loss"]))
        return F.struct(F.array_join(F.transform(x, lambda p: p["text"]), "").alias("formatted"), spans.alias("loss_spans"))

    return chats.select("conv_id", _let(made, result).alias("r")).select("conv_id", "r.formatted", "r.loss_spans")


def read_chats(chats: DataFrame) -> DataFrame:
    """The inverse, beside the columns it reads: turns (role, text), learned (the unescaped texts under the mask)."""
    blocks = F.filter(F.split("formatted", r"<\|end\|>\n"), lambda b: b != "")

    def turns(block: Column) -> Column:
        role = unescape(F.substr(F.substring_index(block, TEXT, 1), F.lit(len(START) + 1)))
        body = F.substr(block, F.length(F.substring_index(block, TEXT, 1)) + len(TEXT) + 1)
        return F.transform(F.split(body, r"<\|next\|>"), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    def inside(text: Column, low: Column, spans: Column) -> Column:
        return F.transform(spans, lambda s: unescape(F.substr(text, (s["start"] - low + 1).cast("int"), s["length"].cast("int"))))

    def group(spans: Column) -> Column:
        """Of neighbouring spans: each is cut out of the text that holds them all, which is found once."""
        low, last = F.get(spans, 0)["start"], F.get(spans, F.size(spans) - 1)
        text = F.substr(F.col("formatted"), (low + 1).cast("int"), (last["start"] + last["length"] - low).cast("int"))
        return _let(text, lambda t: inside(t, low, spans))

    def groups(run: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor(F.size("loss_spans") / run).cast("int")), lambda j: F.slice(F.col("loss_spans"), j * run + 1, run))
        return F.flatten(F.transform(F.filter(parts, lambda p: F.size(p) > 0), group))

    learned = _let(F.greatest(F.lit(1), F.ceil(F.sqrt(F.size("loss_spans"))).cast("int")), groups)
    return chats.select("*", F.flatten(F.transform(blocks, turns)).alias("turns"), learned.alias("learned"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What read_chats gives back of format_chats of conversations, and of one more; see there for nulls and repeats."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    back = read_chats(format_chats(rows.unionByName(more)))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join("learned", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = {
    "op5_chat": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
r AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
  length(text) + length(regexp_replace(text, '[^\\<\[]', '', 'g')) AS n,
  length(role) + length(regexp_replace(role, '[^\\<\[]', '', 'g')) AS m FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n + CASE WHEN before IS NOT DISTINCT FROM role THEN 8 ELSE m + 25 END) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id
"""
}
QUERIES = {"op5_chat": op5_chat}
