"""How far sources differ in their words: stripes folded in the mappers, merged by term, summed into divergences.

A stripe belongs to a term of a language: in how many documents the term stands, and how often in each source.  Tasks
fold whole documents into a hash table of stripes and hand it on when it is full (spill) or the task ends; the stripes
of a term meet in one task and are merged there, so a very frequent term costs one short row per task and spill.
Merged stripes of kept terms, in groups of bounded size, give the divergences of all pairs of sources at once: only the
sources in which a term occurs are visited, the others share one value per source.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.persist import cut
from tessera.llm.common import pick

#: A task spills its stripes when they hold so many (term, source) counts, or come from so many bytes of text.
SPILL_COUNTS = 600_000
SPILL_BYTES = 64 << 20
#: Stripes of one term that are merged at once.
HELD = 4096
#: Text folded at once, cut where no term is.
SLICE = 1 << 20
#: (term, source) counts in a group of merged stripes, and cells (terms x sources) that it holds as a table at once.
GROUP_COUNTS = 200_000
CELLS = 1 << 20
#: Probabilities are counted in units of 1 / UNIT.
UNIT = 1_000_000_000

#: Letters A-Z become a-z, other letters and every byte of a non-ASCII character stay, all else parts terms.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_STRIPES = pa.list_(pa.struct([("source", pa.string()), ("n", pa.int64())]))
_SCHEMA = pa.schema([("lang", pa.string()), ("term", pa.string()), ("df", pa.int64()), ("stripe", _STRIPES)])
_DDL = "lang string, term string, df long, stripe array<struct<source:string,n:long>>"


def terms_of(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a text (UTF-8) in order, a long text in slices."""
    start = 0
    while start < len(raw):
        piece = raw[start : start + SLICE].translate(_FOLD)
        stop = start + len(piece)
        if stop < len(raw):
            last = piece.rfind(b" ")
            while last < 0 and stop < len(raw):  # one term longer than the slice
                more = raw[stop : stop + SLICE].translate(_FOLD)
                last = more.find(b" ")
                last += len(piece) if last >= 0 else 0
                piece, stop = piece + more, stop + len(more)
            if last >= 0:
                piece = piece[:last]
                stop = start + last + 1
        yield piece.split()
        start = stop


class Stripes:
    """A hash table of the stripes of one language: document frequencies, and counts by source."""

    def __init__(self):
        self.df: Counter = Counter()
        self.counts: dict[str, Counter] = {}

    def add(self, source: str, raw: bytes) -> int:
        """Folds one document in; returns by how many counts the table has grown."""
        counts = self.counts.setdefault(source, Counter())
        before = len(counts)
        slices = terms_of(raw)
        first = next(slices, [])
        counts.update(first)
        seen = set(first)
        for more in slices:
            counts.update(more)
            seen.update(more)
        self.df.update(seen)
        return len(counts) - before

    def batches(self, lang: str, rows: int = 8192) -> Iterator[pa.RecordBatch]:
        """The stripes as rows."""
        place = dict(zip(self.df, range(len(self.df))))
        sources = list(self.counts)
        at = [np.fromiter(map(place.__getitem__, c), np.int64, len(c)) for c in self.counts.values()]
        n = np.concatenate([np.fromiter(c.values(), np.int64, len(c)) for c in self.counts.values()])
        source = np.repeat(np.arange(len(sources)), [len(x) for x in at]).astype(np.int32)
        at = np.concatenate(at)
        order = np.argsort(at, kind="stable")
        ends = np.searchsorted(at[order], np.arange(len(place) + 1)).astype(np.int32)
        names = pa.DictionaryArray.from_arrays(pa.array(source[order]), pa.array(sources, pa.string())).dictionary_decode()
        stripe = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([names, pa.array(n[order])], ["source", "n"]))
        terms = pa.array(list(self.df), pa.binary()).cast(pa.string())
        df = pa.array(np.fromiter(self.df.values(), np.int64, len(self.df)))
        for start in range(0, len(place), rows):
            part = slice(start, start + rows)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(terms[part]), pa.string()), terms[part], df[part], stripe[part]], schema=_SCHEMA)


def _fold_documents(spill: int):
    """Folds whole documents into stripes; the tables are handed on whenever they hold ``spill`` counts."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, Stripes] = {}
        held = size = 0
        for batch in batches:
            langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
            for lang, source, text in zip(langs, sources, batch.column("text")):
                raw = text.as_buffer().to_pybytes()
                held += tables.setdefault(lang, Stripes()).add(source, raw)
                size += len(raw)
                if held >= spill or size >= SPILL_BYTES:
                    for name, table in tables.items():
                        yield from table.batches(name)
                    tables, held, size = {}, 0, 0
        for name, table in tables.items():
            yield from table.batches(name)

    return fold


def _group_starts(table: pa.Table) -> np.ndarray:
    """Rows that begin a run of equal (lang, term)."""
    lang, term = (table.column(c).combine_chunks() for c in ("lang", "term"))
    new = pc.or_(pc.not_equal(lang[1:], lang[:-1]), pc.not_equal(term[1:], term[:-1]))
    return np.flatnonzero(np.concatenate([[True], new.to_numpy(zero_copy_only=False)]))


def _merged(table: pa.Table, starts: np.ndarray, least: int) -> pa.Table:
    """One stripe for each run of rows from ``starts``; runs in fewer than ``least`` documents go first."""
    df = np.add.reduceat(table.column("df").to_numpy(), starts)
    kept = df >= least
    sizes = np.diff(np.append(starts, table.num_rows))
    run = np.repeat(np.cumsum(kept) - 1, sizes)
    rows = np.flatnonzero(np.repeat(kept, sizes))
    stripe = table.column("stripe").combine_chunks().take(pa.array(rows))
    entries = stripe.flatten()
    of = np.repeat(run[rows], np.diff(stripe.offsets.to_numpy()))
    summed = pa.table({"run": of, "source": entries.field(0), "n": entries.field(1)}).group_by(["run", "source"]).aggregate([("n", "sum")]).sort_by("run")
    ends = np.searchsorted(summed.column("run").to_numpy(), np.arange(int(kept.sum()) + 1)).astype(np.int32)
    pairs = pa.StructArray.from_arrays([summed.column("source").combine_chunks(), summed.column("n_sum").combine_chunks()], ["source", "n"])
    heads = pa.array(starts[kept])
    return pa.table([table.column("lang").combine_chunks().take(heads), table.column("term").combine_chunks().take(heads),
                     pa.array(df[kept]), pa.ListArray.from_arrays(pa.array(ends), pairs)], schema=_SCHEMA)


def _merge_sorted(least: int, held: int):
    """Merges the stripes of equal (lang, term), which follow each other; terms in fewer than ``least`` documents go."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_rows: pa.Table | None = None  # from the start of the last term, whose stripes may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch]).cast(_SCHEMA)
            table = table if open_rows is None else pa.concat_tables([open_rows, table])
            starts = _group_starts(table)
            if len(starts) > 1:
                yield from _merged(table.slice(0, starts[-1]), starts[:-1], least).to_batches()
            open_rows = table.slice(starts[-1])
            if open_rows.num_rows >= held:
                open_rows = _merged(open_rows, np.zeros(1, dtype=np.int64), 0)
        if open_rows is not None:
            yield from _merged(open_rows, np.zeros(1, dtype=np.int64), least).to_batches()

    return merge


def merged_stripes(docs: DataFrame, least: int, spill: int = SPILL_COUNTS, held: int = HELD) -> DataFrame:
    """(lang, term, df, stripe) of the terms that stand in at least ``least`` documents of their language."""
    folded = docs.select("lang", "source", "text").mapInArrow(_fold_documents(spill), _DDL)
    return folded.repartition("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(_merge_sorted(least, held), _DDL)


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * count / total) in three exact steps of a thousand, so that counts up to 9e15 fit 64 bits."""
    whole, rest = np.divmod(count, total)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + digits
    return 1 + whole


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _emit(top: int, cells: int):
    """The divergences of one group of merged stripes: all pairs of its language's sources, and each source's top terms."""

    def emit(stripes: pa.Table, language: pa.Table) -> pa.Table:
        lang = language.column("lang")[0].as_py()
        sources = language.column("sources")[0].as_py()
        kept = language.column("terms")[0].as_py()
        names = [s["source"] for s in sources]
        totals = np.array([s["n"] for s in sources], dtype=np.int64) + 2 * kept
        lang_total = int(language.column("n")[0].as_py()) + 2 * kept
        width = len(names)
        pair = np.zeros((width, width), dtype=np.int64)
        best: list[tuple[str, int, bytes]] = []
        if stripes.num_rows:
            table = stripes.combine_chunks()
            terms = table.column("term").to_pylist()
            stripe = table.column("stripe").chunk(0)
            sizes = np.diff(stripe.offsets.to_numpy())
            index = {s: i for i, s in enumerate(names)}
            coded = stripe.flatten().field(0).dictionary_encode()
            column = np.array([index[s] for s in coded.dictionary.to_pylist()], dtype=np.int64)[coded.indices.to_numpy()]
            count = stripe.flatten().field(1).to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(terms)), sizes)
            none = share(np.full(width, 2, dtype=np.int64), totals)  # a source without the term
            step = max(1, cells // width)
            for start in range(0, len(terms), step):
                stop = min(len(terms), start + step)
                inside = slice(*np.searchsorted(row, [start, stop]))
                r, c, n = row[inside] - start, column[inside], count[inside]
                shares = np.repeat(none[None], stop - start, axis=0)
                shares[r, c] = share(n + 2, totals[c])
                has = np.zeros(shares.shape, dtype=bool)
                has[r, c] = True
                both = np.zeros_like(pair)
                for s in range(width):
                    rows = np.flatnonzero(has[:, s])
                    if len(rows):
                        away = distance(shares[rows, s][:, None], shares[rows])
                        with_t = has[rows]
                        both[s] = with_t.sum(axis=0)
                        pair[s] += away.sum(axis=0)  # terms that s has
                        pair[:, s] += np.where(with_t, 0, away).sum(axis=0)  # terms that only s has, seen from t
                own = np.diag(both)
                pair += (stop - start - own[:, None] - own[None, :] + both) * distance(none[:, None], none[None, :])
                whole = np.zeros(stop - start, dtype=np.int64)
                np.add.at(whole, r, n)
                general = share(whole + 2, np.int64(lang_total))[r]
                value = np.where(shares[r, c] > general, distance(shares[r, c], general), -1)
                for s in np.unique(c):
                    mine = np.flatnonzero((c == s) & (value >= 0))
                    if len(mine) > top:
                        mine = mine[value[mine] >= np.partition(value[mine], len(mine) - top)[len(mine) - top]]
                    found = sorted((-int(value[i]), terms[start + r[i]].encode()) for i in mine)[:top]
                    best += [(names[s], -v, t) for v, t in found]
        s, t = np.nonzero(~np.eye(width, dtype=bool))
        out_source = [names[i] for i in s] + [b[0] for b in best]
        out_part = ["pair"] * len(s) + ["term"] * len(best)
        out_item = [names[i] for i in t] + [b[2].decode() for b in best]
        out_value = np.concatenate([pair[s, t], np.array([b[1] for b in best], dtype=np.int64)])
        return pa.table({"lang": pa.array([lang] * len(out_source), pa.string()), "source": pa.array(out_source, pa.string()),
                         "part": pa.array(out_part, pa.string()), "item": pa.array(out_item, pa.string()),
                         "value": pa.array(out_value, pa.int64())})

    return lambda key, stripes, language: emit(stripes, language)


def source_divergence(docs: DataFrame, least: int = 10, top: int = 10, lang_col: str = "lang", source_col: str = "source",
                      text_col: str = "text", spill: int = SPILL_COUNTS, group: int = GROUP_COUNTS, cells: int = CELLS) -> DataFrame:
    """(lang, source, part, item, value, rank): how each source's words differ from other sources' and the language's.

    Terms are runs of ASCII letters (lower-cased) and non-ASCII characters; a language keeps those in at least ``least``
    of its documents.  Every (lang, source) of the table gives a kept term the share p = 1 + floor(1e9 * (count + 2) /
    (N + 2 V)), and the language does so with its own counts; the distance of two shares is floor((p - q)^2 / (p + q)).
    Part ``pair``: the distance to each other source, summed over all kept terms.  Part ``term``: the ``top`` terms that
    stand in the source with a higher share than in the language.  Ranks count from 1 by value (largest first), then by
    item (bytes).  Null texts, languages and sources count as empty ones; a group without any term has pairs like all
    others; repeated rows count as documents of their own; an empty table gives no rows; other columns play no part.
    Texts of any length are folded in slices.  All arithmetic is in exact integers.
    ``spill``, ``group`` and ``cells`` bound what a task holds; they change no result.
    """
    empty = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("lang", "source", "text")}
    rows = pick(docs, lang=lang_col, source=source_col, text=text_col).withColumns(empty)
    kept = cut(merged_stripes(rows, least, spill, min(spill, HELD)))
    counts = kept.select("lang", F.explode("stripe").alias("s")).groupBy("lang", F.col("s.source").alias("source")).agg(F.sum("s.n").alias("n"))
    groups = rows.groupBy("lang", "source").agg(F.lit(0).cast("long").alias("none")).drop("none").join(counts, ["lang", "source"], "left")
    sizes = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum(F.size("stripe")).alias("counts"))
    source_list = F.sort_array(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0).cast("long")).alias("n")))).alias("sources")
    languages = groups.groupBy("lang").agg(source_list, F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("width"))
    # a group holds many stripes, and more the more sources there are, since each group gives one row per pair of sources
    per_group = F.greatest(F.lit(group), F.floor(F.col("width") * F.col("width") / 4))
    languages = cut(languages.join(sizes, "lang", "left").fillna(0, ["terms", "counts"])
                    .withColumn("buckets", F.greatest(F.lit(1), F.ceil(F.col("counts") / per_group)).cast("int")))
    dealt = kept.join(languages.select("lang", "buckets"), "lang").withColumn("bucket", F.pmod(F.xxhash64("term"), "buckets").cast("int"))
    asked = languages.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)))
    emitted = (dealt.select("lang", "bucket", "term", "stripe").groupBy("lang", "bucket")
               .cogroup(asked.select("lang", "bucket", "sources", "n", "terms").groupBy("lang", "bucket"))
               .applyInArrow(_emit(top, cells), "lang string, source string, part string, item string, value long"))
    summed = emitted.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    ranks = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    return summed.withColumn("rank", F.row_number().over(ranks)).filter((F.col("part") == "pair") | (F.col("rank") <= top))
