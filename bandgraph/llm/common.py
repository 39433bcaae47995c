"""Expressions and graph helpers that several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from bandgraph.session import cut

#: Fixed value: the words of the SPACE-separated contracts.
SPACED_WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else; lower() does just that on pure ASCII and is much faster than translate()."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id's text modulo n; a null id is in fold 1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % n, F.lit(1))


def own_names(df: DataFrame, *names: str) -> list[str]:
    """names, each with as many underscores before it as it takes to be no column of df (names count in lower case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> Column:
    """The column of just this name, which may have dots or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def without(df: DataFrame, *names: str) -> list[str]:
    """df's columns but those of the names, in lower case or not."""
    gone = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in gone]


#: Keys with about this many marks or more are hot; one mark in SAMPLE is looked at to find them. Hot keys up to this many
#: are broadcast, which is some tens of megabytes.
HOT, SAMPLE, MOST_HOT = 2_048, 64, 1_000_000


def meetings(marks: DataFrame, key: str, member: str) -> DataFrame:
    """(key, member, head) of cut marks (key, member), for keys that several members have; head is the least of them.

    Marks are dealt out by key once, for the sums and for the join with them. Hot keys, found in a sample of the marks,
    go another way: their few heads are summed before the shuffle and broadcast, so that no task gathers a hot key.
    Hot keys that are too many for that are left to the splitting of skewed joins, with sums before the shuffle all the same.
    """
    hot = cut(marks.where(F.rand(7) < 1.0 / SAMPLE).groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= HOT // SAMPLE).select(key))
    n = hot.count()
    ends = lambda m: m.groupBy(key).agg(F.min(member).alias("head"), F.max(member).alias("tail")).where("head <> tail").select(key, "head")
    if n > MOST_HOT:
        return marks.join(ends(marks), key)
    cold = marks.join(F.broadcast(hot), key, "left_anti") if n else marks
    cold = cold.repartition(int(marks.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    cold = cold.join(ends(cold).hint("shuffle_hash"), key)
    if not n:
        return cold
    warm = marks.join(F.broadcast(hot), key, "left_semi")
    return cold.union(warm.join(F.broadcast(ends(warm)), key))


def split_keys(members: DataFrame, key: str, member: str, comp: DataFrame, chunk: int = 512) -> tuple[DataFrame, DataFrame]:
    """Two frames whose join on (key, i, j) has the pairs of members that share a key and lie in different components.

    members (key, member); comp (node, comp). Only keys with several components are kept. There, members outside the
    largest component (x, of component xc) meet all (y, yc), both dealt out in chunks, so no key is one task's. The caller
    adds conditions to the join, xc <> yc the first, so that no other pair becomes a row.
    """
    inside = members.join(comp, F.col(member) == F.col("node"), "left").select(key, member, F.coalesce("comp", member).alias("comp")).distinct()
    main = inside.groupBy(key, "comp").agg(F.count("*").alias("k")).groupBy(key).agg(F.max(F.struct("k", "comp")).alias("top"), F.sum("k").alias("m"))
    part = lambda n: F.ceil(n / chunk).cast("int")
    main = main.where("top.k < m").select(key, F.col("top.comp").alias("main"), part(F.col("m")).alias("chunks"), part(F.col("m") - F.col("top.k")).alias("out_chunks"))
    inside = cut(inside.join(main, key))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.hash(member), F.col(n))
    x = inside.where("comp <> main").select(key, own("out_chunks").alias("i"), spread("chunks").alias("j"), F.col(member).alias("x"), F.col("comp").alias("xc"))
    y = inside.select(key, spread("out_chunks").alias("i"), own("chunks").alias("j"), F.col(member).alias("y"), F.col("comp").alias("yc"))
    return x, y
