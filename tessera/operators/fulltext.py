"""Stored full-text search: postings with positions, a stemmed lexicon, web-search queries, headlines.

The index is three Parquet tables under one folder, each written in generations so that documents are added
without rewriting:

  postings   gen, bucket, config, word, docs, positions     one row a word and slice of texts, in buckets by word
  lexicon    gen, config, word, stem                        each word once, stemmed when it is first met
  documents  gen, doc_id, config                            written last: a generation counts once it is here

Postings are by surface word, so stemming runs once a word of the lexicon.  A query's terms are stemmed, looked up in the
lexicon, and only the buckets and words found are read; texts are not.  Stop words hold their places but have no postings.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.stemming import stems
from tessera.operators.passages import WebQuery, parse_websearch

#: The public stop word lists of both languages.
STOPS = {
    "english": (
        "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those "
        "am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below to from "
        "up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now"
    ).split(),
    "french": (
        "au aux avec ce ces dans de des du elle en et eux il je la le leur lui ma mais me même mes moi mon ne nos notre nous on ou par pas pour qu que qui sa se ses sur ta te tes toi ton tu un une vos votre vous c d j l à m n s t y "
        "étée étées étant suis es êtes sont serai seras sera serons serez seront serais serait serions seriez seraient étais était étions étiez étaient fus fut fûmes fûtes furent sois soit soyons soyez soient fusse fusses fussions fussiez fussent "
        "ayant eu eue eues eus ai as avons avez ont aurai auras aura aurons aurez auront aurais aurait aurions auriez auraient avais avait avions aviez avaient eut eûmes eûtes eurent aie aies ait ayons ayez aient eusse eusses eût eussions eussiez eussent"
    ).split(),
    "simple": [],
}
CONFIGS = {"en": "english", "fr": "french"}
POSTINGS = "config string, word string, docs array<long>, positions array<int>, gen int, bucket int"
LEXICON = "config string, word string, stem string, gen int"
DOCUMENTS = "doc_id long, config string, gen int"
_SLICE = 16 << 20  # bytes of text that a task holds as words
_KNOWN = 500_000  # words whose stems a task keeps


def words_of(text: str) -> list[str]:
    """Lower-case runs of letters and digits; positions count them from 1."""
    return re.findall(r"[^\W_]+", text.lower())


def config_of(language: Column) -> Column:
    return reduce(lambda e, kv: e.when(language == kv[0], kv[1]), list(CONFIGS.items())[1:], F.when(language == next(iter(CONFIGS)), CONFIGS[next(iter(CONFIGS))])).otherwise("simple")


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct words, and of each word of the texts in order its code, its text and its place)."""
    clean = pc.utf8_lower(pc.replace_substring_regex(texts, r"[^\p{L}\p{N}]+", " "))
    lists = pc.ascii_split_whitespace(clean)
    flat, ends = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    real = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    flat, upto = flat.filter(pa.array(real)), np.concatenate([[0], np.cumsum(real)])
    sizes = np.diff(upto[ends])
    doc = np.repeat(np.arange(len(texts)), sizes)
    coded = flat.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), doc, np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1


def _slices(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about _SLICE bytes of the column `text`, or of one row."""
    for batch in batches:
        ends, at = np.cumsum(pc.binary_length(batch.column(text)).to_numpy(zero_copy_only=False), dtype=np.int64), 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _SLICE, "right")))
            yield batch.slice(at, to - at)
            at = to


def postings_of(docs: DataFrame) -> DataFrame:
    """(config, word, docs, positions) of (doc_id, config, text): a word's occurrences in a slice of the texts, by document and
    place, as two lists of one length; grouped inside each slice, nothing is shuffled.
    """

    def run(batches):
        for batch in _slices(batches, 2):
            ids, configs, texts = batch.columns
            names, code, doc, place = _words(texts)
            known = configs.dictionary_encode()
            kept, config = np.ones(len(doc), bool), known.indices.to_numpy()[doc]
            for i, name in enumerate(known.dictionary.to_pylist()):
                if STOPS[name]:
                    kept &= ~((config == i) & pc.is_in(names, pa.array(STOPS[name])).to_numpy(zero_copy_only=False)[code])
            key = (config * np.int64(len(names)) + code)[kept]
            order = np.argsort(key, kind="stable")  # documents and places are in order already
            key, doc, place = key[order], doc[kept][order], place[kept][order]
            heads = np.flatnonzero(np.diff(key, prepend=-1) != 0)
            ends = pa.array(np.append(heads, len(key)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, x) for x in (ids.take(pa.array(doc)), pa.array(place.astype(np.int32)))]
            yield pa.RecordBatch.from_arrays([known.dictionary.take(pa.array(key[heads] // len(names))), names.take(pa.array(key[heads] % len(names))), *lists], names=["config", "word", "docs", "positions"])

    return docs.select("doc_id", "config", "text").mapInArrow(run, "config string, word string, docs array<long>, positions array<int>")


def analyzed(docs: DataFrame, config: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, positions, stems): of each row, the stems of its words in order and their positions, without stop words.

    Nothing is shuffled: a task sends the words of a slice of texts that are new to it through the stemmer, and behind them
    the slice's texts as numbers of the words known so far.  Rows without an id or without words are left out.
    """

    def row_batch(words, ids, positions, codes):
        return pa.RecordBatch.from_arrays([words, ids, positions, codes], names=["word", "doc_id", "positions", "codes"])

    def of_words(words):
        return row_batch(words, pa.nulls(len(words), pa.int64()), *(pa.nulls(len(words), pa.list_(pa.int32())) for _ in range(2)))

    def coded(batches):
        known = pa.array([], pa.string())
        for batch in _slices(batches, 1):
            ids, texts = batch.columns
            names, code, doc, place = _words(texts)
            kept = ~pc.is_in(names, pa.array(STOPS[config], pa.string())).to_numpy(zero_copy_only=False)[code]
            code, doc, place = code[kept], doc[kept], place[kept].astype(np.int32)
            if len(known) > _KNOWN:  # a word of nothing: forget what came before
                known = known.slice(0, 0)
                yield of_words(pa.nulls(1, pa.string()))
            new = names.filter(pc.invert(pc.is_in(names, known)))
            known = pa.concat_arrays([known, new])
            heads = np.flatnonzero(np.diff(doc, prepend=-1) != 0)
            ends = pa.array(np.append(heads, len(doc)).astype(np.int32))
            codes = pc.index_in(names, known).to_numpy()[code]
            yield of_words(new)
            yield row_batch(pa.nulls(len(heads), pa.string()), ids.take(pa.array(doc[heads])), *(pa.ListArray.from_arrays(ends, pa.array(x)) for x in (place, codes)))

    def put(batches):
        stem = []  # of the words known so far
        for batch in batches:
            is_text = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            bounds = [0, *(np.flatnonzero(np.diff(is_text)) + 1).tolist(), batch.num_rows]
            for a, b in zip(bounds, bounds[1:], strict=False):
                part = batch.slice(a, b - a)
                if a == b:
                    continue
                if not is_text[a]:
                    more = part.column("stem")
                    ends = np.flatnonzero(more.is_null().to_numpy(zero_copy_only=False))
                    stem = [more.slice(int(ends[-1]) + 1)] if len(ends) else [*stem, more]
                    continue
                stem = [pa.concat_arrays(stem)]
                codes = part.column("codes")
                ends = pa.array((codes.offsets.to_numpy() - codes.offsets[0].as_py()).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("positions"), pa.ListArray.from_arrays(ends, stem[0].take(codes.flatten()))], names=["doc_id", "positions", "stems"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("string").alias("text")).where("doc_id IS NOT NULL")
    words = rows.mapInArrow(coded, "word string, doc_id long, positions array<int>, codes array<int>")
    return stems(words, config).select("stem", "doc_id", "positions", "codes").mapInArrow(put, "doc_id long, positions array<int>, stems array<string>")


@dataclass(frozen=True)
class FullText:
    """An index in a folder that the cluster shares."""

    spark: SparkSession
    path: str
    buckets: int = 64

    def table(self, name: str, schema: str, last: int | None = None) -> DataFrame | None:
        """A table's rows of the generations up to `last`, by default all that were written whole; None before the first."""
        last = self.generations() if last is None else last
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}").where(F.col("gen") <= last) if last else None

    def documents(self) -> DataFrame | None:
        return self.table("documents", DOCUMENTS)

    def generations(self) -> int:
        """How many generations are whole: they are numbered from 1, and their documents are written last."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        store, n = path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration()), 0
        while store.exists(path(f"{self.path}/documents/gen={n + 1}/_SUCCESS")):
            n += 1
        return n

    def bucket(self, config: Column, word: Column) -> Column:
        return F.pmod(F.xxhash64(config, word), F.lit(self.buckets)).cast("int")

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", language: Column | None = None) -> int:
        """Index the documents whose ids are not in yet, as one more generation; the number of generations.

        Null texts have no words; rows without an id are left out; of an id's rows, which should be one, all words
        count.  Only one writer at a time.  What a writer that failed left behind is overwritten by the next.
        """
        own = lambda c: F.col(f"`{c}`")
        rows = docs.select(own(id_col).cast("long").alias("doc_id"), (config_of(language) if language is not None else F.lit("simple")).alias("config"), F.coalesce(own(text_col), F.lit("")).cast("string").alias("text")).where("doc_id IS NOT NULL")
        last = self.generations()
        if last:
            rows = rows.join(self.documents().select("doc_id"), "doc_id", "left_anti")
            if rows.isEmpty():
                return last
        gen = last + 1
        put = lambda df, name: df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/{name}/gen={gen}")
        dealt = postings_of(rows).withColumn("bucket", self.bucket(F.col("config"), F.col("word"))).hint("rebalance", "bucket")  # a word that is everywhere is split
        dealt.sortWithinPartitions("bucket", "config", "word").write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{self.path}/postings/gen={gen}")
        stored = self.spark.read.schema(POSTINGS).parquet(f"{self.path}/postings/gen={gen}")
        words = stored.select("config", "word").distinct()
        if last:
            words = words.join(self.table("lexicon", LEXICON, last).select("config", "word"), ["config", "word"], "left_anti")
        found = reduce(DataFrame.unionByName, (stems(words.where(F.col("config") == c), c) for c in STOPS))
        put(found.sortWithinPartitions("config", "stem", "word"), "lexicon")
        put(rows.select("doc_id", "config").distinct(), "documents")
        return gen

    def stems_of(self, words: Sequence[str], config: str) -> dict[str, str]:
        """Stems of a query's words that are no stop words; evaluated on the driver as literals."""
        asked = [w for w in dict.fromkeys(words) if w not in STOPS[config]]
        if not asked:
            return {}
        rows = self.spark.sql("SELECT col1 AS word FROM VALUES " + ", ".join(f"('{w}')" for w in asked))  # letters and digits only
        return {r["word"]: r["stem"] for r in stems(rows, config).collect()}

    def hits(self, query: str | WebQuery, config: str) -> DataFrame:
        """(doc_id, hits, found): documents that answer a query, how often its wanted words occur, and array<array<int>>: the
        positions of each of its terms, in order of first mention.

        A phrase's words stand one behind the other, stop words counting as any word.  A query of nothing, or
        of stop words and exclusions alone, finds nothing.
        """
        query = parse_websearch(query, words_of) if isinstance(query, str) else query
        stem = self.stems_of([w for g in [*query.any_of, query.none_of] for phrase in g for w in phrase], config)
        placed = lambda phrase: [(stem[w], i) for i, w in enumerate(phrase) if w in stem]
        any_of = [x for g in query.any_of if (x := [p for p in map(placed, g) if p])]
        none_of = [p for p in map(placed, query.none_of) if p]
        terms = list(dict.fromkeys(s for g in [*any_of, none_of] for p in g for s, _ in p))
        last = self.generations() if any_of else 0
        lexicon, postings = self.table("lexicon", LEXICON, last), self.table("postings", POSTINGS, last)
        if postings is None:
            return self.spark.createDataFrame([], "doc_id long, hits int, found array<array<int>>")
        # the inflections of the query's own words: a few a term
        known = {r["word"]: terms.index(r["stem"]) for r in lexicon.where((F.col("config") == config) & F.col("stem").isin(terms)).select("word", "stem").collect()}
        if not known:
            return self.spark.createDataFrame([], "doc_id long, hits int, found array<array<int>>")
        keys = self.spark.sql("SELECT col1 AS word FROM VALUES " + ", ".join(f"('{w}')" for w in known)).select(self.bucket(F.lit(config), F.col("word")).alias("b"))
        buckets = sorted({r["b"] for r in keys.collect()})
        rows = postings.where(F.col("bucket").isin(buckets) & (F.col("config") == config) & F.col("word").isin(list(known)))
        term = F.element_at(F.create_map(*(F.lit(x) for kv in known.items() for x in kv)), F.col("word"))
        at = lambda i: F.array_sort(F.collect_list(F.when(F.col("term") == i, F.col("positions"))))
        found = rows.select(term.alias("term"), F.inline(F.arrays_zip(F.col("docs").alias("doc_id"), "positions"))).groupBy("doc_id").agg(F.array(*map(at, range(len(terms)))).alias("found"))
        at_term = lambda s: F.col("found")[terms.index(s)]

        def starts(phrase):  # where a phrase begins
            return reduce(F.array_intersect, [_moved(at_term(s), off) for s, off in phrase])

        holds = lambda p: F.size(starts(p) if len(p) > 1 else at_term(p[0][0])) > 0
        both = lambda xs: reduce(lambda a, b: a & b, xs, F.lit(True))
        good = reduce(lambda a, b: a | b, (both(map(holds, g)) for g in any_of)) & both(~holds(p) for p in none_of)
        wanted = sorted({terms.index(s) for g in any_of for p in g for s, _ in p})
        return found.where(good).select("doc_id", reduce(lambda a, b: a + b, (F.size(F.col("found")[i]) for i in wanted)).alias("hits"), F.array(*(F.col("found")[i] for i in wanted)).alias("found"))

    def ranked(self, query: str | WebQuery, config: str, k: int) -> DataFrame:
        """The k documents with most hits, ties by id."""
        return self.hits(query, config).orderBy(F.desc("hits"), "doc_id").limit(k)


def _moved(positions: Column, by: int) -> Column:
    return F.transform(positions, lambda p: p - by)


# -- headlines -----------------------------------------------------------------------------------


def fragments(hits: DataFrame, most: int = 35, number: int = 2) -> DataFrame:
    """(doc_id, part, start, end): up to `number` covers a document, of `most` words or fewer, best first.

    A cover begins at a hit and ends at the last hit within its words.  The best holds the most terms, then the most hits,
    then is shortest, then comes first; each further one is the best that overlaps none before it.
    """
    each = hits.select("doc_id", F.posexplode("found").alias("term", "at")).select("doc_id", "term", F.explode("at").alias("at"))
    ahead = Window.partitionBy("doc_id").orderBy("at").rangeBetween(0, most - 1)
    covers = each.select("doc_id", "at", F.max("at").over(ahead).alias("end"), F.count(F.lit(1)).over(ahead).alias("n"), F.size(F.collect_set("term").over(ahead)).alias("terms")).distinct()
    worth = F.struct("terms", "n", (F.col("at") - F.col("end")).alias("short"), (-F.col("at")).alias("early"), F.col("end").alias("end"))
    out = []
    for part in range(number):
        best = covers.groupBy("doc_id").agg(F.max(worth).alias("w")).select("doc_id", F.lit(part).alias("part"), (-F.col("w.early")).alias("start"), F.col("w.end").alias("end"))
        out.append(best)
        if part + 1 < number:
            taken = best.select("doc_id", F.col("start").alias("_s"), F.col("end").alias("_e"))
            covers = covers.join(taken, "doc_id").where((F.col("at") > F.col("_e")) | (F.col("end") < F.col("_s"))).drop("_s", "_e")
    return reduce(DataFrame.unionByName, out)


def headlines(hits: DataFrame, docs: DataFrame, least: int = 15, most: int = 35, number: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, headline): the covers of each found document in order, the words found in <b>, joined by " … ".

    A cover of fewer than `least` words is widened by as many words on either side (one more behind), as far as the text
    and the fragment before it reach.  Only the texts of documents in `hits` are read.
    """
    spans = F.array_sort(F.transform(F.collect_list(F.struct("start", "end")), lambda s: _widened(s, least)))
    parts = fragments(hits, most, number).groupBy("doc_id").agg(spans.alias("spans"))
    places = hits.select("doc_id", F.flatten("found").alias("places"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"))
    found = texts.join(parts, "doc_id").join(places, "doc_id")  # a text is cut into words once it is known to be shown
    wide = found.select("doc_id", "spans", "places", F.regexp_extract_all("_text", F.lit(r"[\p{L}\p{N}]+[^\p{L}\p{N}]*"), F.lit(0)).alias("words"))

    def shown(span, before):  # before: the spans ahead of it
        start = F.greatest(span["start"], F.lit(1), F.coalesce(F.array_max(before["end"]), F.lit(0)) + 1)
        some = F.transform(F.slice("words", start, F.greatest(F.least(span["end"], F.size("words")) - start + 1, F.lit(0))), lambda w, i: F.when(F.array_contains("places", i + start), F.regexp_replace(w, r"^([\p{L}\p{N}]+)", "<b>$1</b>")).otherwise(w))
        return F.trim(F.regexp_replace(F.array_join(some, ""), r"\s+", " "))

    pieces = F.transform("spans", lambda s, i: shown(s, F.slice(F.col("spans"), F.lit(1), i)))
    return wide.select("doc_id", F.array_join(F.filter(pieces, lambda p: p != ""), " … ").alias("headline"))


def _widened(span: Column, least: int) -> Column:
    lack = F.greatest(F.lit(least) - (span["end"] - span["start"] + 1), F.lit(0))
    before = F.floor(lack / 2).cast("int")
    return F.struct((span["start"] - before).alias("start"), (span["end"] + lack - before).alias("end"))
