"""Chat formatting by quotation linking.

A message's lines carry a quote level, the number of leading ">" marks. Lines of level 0 are its own
words; a run of lines of one level above 0 is a quoted passage. Passages, and their lines, are normalised
(white space made single, lower case) and hashed; so are the paragraphs and lines of every message's own
words. A join on conversation and hash finds the original: the first message of the conversation that says
the passage, if it stands before the quoting one. The original with most of the level-1 passages is what a message
replies to; replies chain to threads, and conversations are given in thread order without quotes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, table, written

MARK = re.compile(r"[ \t]*((?:>[ \t]?)+)(.*)", re.S)
#: The line that announces a quote goes with it.
ANNOUNCE = re.compile(r"^.*\b(wrote|schrieb|a écrit|escribió) ?:$", re.I)


def normal(text: str) -> str:
    return " ".join(text.split()).lower()


def digest(text: str) -> int:
    """A 63-bit number for a normalised passage, of a cryptographic hash: different passages do not meet."""
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") >> 1


def level(line: str) -> tuple[int, str]:
    m = MARK.match(line)
    return (m[1].count(">"), m[2]) if m else (0, line)


def parse(text: str | None) -> tuple[str, list[int], list[tuple[int, int, int]]]:
    """The text without quotes, hashes of its own passages, and (level, hash, words) of what it quotes.

    Passages are runs of lines of one level between empty lines; of a passage with several lines each line counts too,
    so passages that were wrapped anew and parts of passages are found. Line ends are \\n or \\r\\n."""
    runs: list[tuple[int, list[str]]] = []
    for line in (text or "").replace("\r\n", "\n").split("\n"):
        n, rest = level(line)
        if runs and runs[-1][0] == n:
            runs[-1][1].append(rest)
        else:
            runs.append((n, [rest]))
    own: set[int] = set()
    quotes: dict[tuple[int, int], int] = {}
    kept: list[str] = []
    for i, (n, lines) in enumerate(runs):
        if n == 0:
            if i + 1 < len(runs) and lines and ANNOUNCE.match(lines[-1].strip()):
                lines = lines[:-1]
            kept += lines
        part: list[str] = []
        for line in [*lines, ""]:
            if x := normal(line):
                part.append(x)
                continue
            for p in {" ".join(part), *part} - {""}:
                if n == 0:
                    own.add(digest(p))
                else:
                    quotes[n, digest(p)] = len(p.split())
            part = []
    clean = "\n".join(x.rstrip() for x in kept).strip("\n")
    return re.sub(r"\n{3,}", "\n\n", clean) if quotes else "\n".join(kept), sorted(own), [(n, h, w) for (n, h), w in sorted(quotes.items())]


def parsed(messages: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, text (without quotes), key (of the raw text), own, quotes."""
    kind = pa.list_(pa.struct([("level", pa.int32()), ("hash", pa.int64()), ("words", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(3).to_pylist()
            rows = [parse(t) for t in raw]
            quotes = [[{"level": n, "hash": h, "words": w} for n, h, w in q] for _, _, q in rows]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:3], pa.array([r[0] for r in rows], pa.string()), pa.array([digest(t or "") for t in raw], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int64())), pa.array(quotes, kind)],
                names=["conv_id", "turn", "role", "text", "key", "own", "quotes"],
            )

    cut = messages.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).alias("text"))
    return mapped(cut, run, "conv_id long, turn long, role string, text string, key long, own array<long>, quotes array<struct<level:int,hash:long,words:long>>")


def link(messages: DataFrame, **columns: str) -> DataFrame:
    """conv_id, turn, role, text, reply_to, thread, n_quotes, links: the messages without quotes, with what they answer.

    links: (level, turn) of the original at every quote level found. reply_to: of the lowest level found, null if the message
    quotes no earlier one. An original is the first message that says a passage; among originals of a level the one with most
    quoted words, then the later. thread: the turn where the chain of replies starts. Null texts are empty messages; null
    conversations or turns link nothing; repeated rows are kept and linked alike. A conversation may be of any size: nothing
    gathers it in one place. Order by conv_id, thread, turn for the reply-ordered conversation."""
    rows = written(parsed(messages, **columns), "messages")
    first = rows.select("conv_id", "turn", F.explode("own").alias("hash")).groupBy("conv_id", "hash").agg(F.min("turn").alias("original"))
    quoted = rows.select("conv_id", "turn", "key", F.explode("quotes").alias("q")).select("conv_id", "turn", "key", "q.*").distinct()
    hits = quoted.join(first, ["conv_id", "hash"]).where(F.col("original") < F.col("turn"))
    votes = hits.groupBy("conv_id", "turn", "key", "level", "original").agg(F.sum("words").alias("words"))
    best = votes.groupBy("conv_id", "turn", "key", "level").agg(F.max_by("original", F.struct("words", "original")).alias("original"))
    links = best.groupBy("conv_id", "turn", "key").agg(F.array_sort(F.collect_list(F.struct("level", F.col("original").alias("turn")))).alias("links"))
    out = rows.join(links, ["conv_id", "turn", "key"], "left").withColumn("reply_to", F.col("links")[0]["turn"]).withColumn("n_quotes", F.size("quotes").cast("long"))
    roots = threads(written(links.select("conv_id", "turn", F.col("links")[0]["turn"].alias("to")).groupBy("conv_id", "turn").agg(F.max("to").alias("to")), "replies"))
    out = out.join(roots, ["conv_id", "turn"], "left")
    kind = "array<struct<level:int,turn:bigint>>"
    return out.select("conv_id", "turn", "role", "text", "reply_to", F.coalesce("root", "turn").alias("thread"), "n_quotes", F.coalesce("links", F.array().cast(kind)).alias("links"))


def threads(replies: DataFrame) -> DataFrame:
    """(conv_id, turn, root): where each chain of replies starts; every round doubles the steps taken."""
    now = replies.select("conv_id", "turn", F.col("to").alias("root"))
    while True:
        step = now.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("further"))
        nxt = written(now.join(step, ["conv_id", "root"], "left").select("conv_id", "turn", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "threads")
        if nxt.where("moved").isEmpty():
            return nxt.drop("moved")
        now = nxt.drop("moved")


def conversations(messages: DataFrame, **columns: str) -> DataFrame:
    """The linked messages in reply order: ranges of conversations by partition, sorted, a long one over several partitions."""
    out = link(messages, **columns)
    n = int(out.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return out.repartitionByRange(n, "conv_id", "thread", "turn").sortWithinPartitions("conv_id", "thread", "turn", "text")


def op8_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, role, text, reply_to, thread, n_quotes, links: every message without its quotes, in reply order.

    Null texts are empty messages; null conversations or turns link nothing; repeated rows are kept and linked alike."""
    return conversations(table(spark, sf_dir, "conversations"))
