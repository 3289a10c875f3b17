"""Language of web pages: text likelihoods, declared language, and host priors, combined by Bayes' rule."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import hashing
from tidemark.llm.common import chunks, lists, map_chunks, meet, ship, stage, utf8
from tidemark.llm.decontaminate import words_of

BUCKETS = 1 << 13
#: Languages whose counts a counting task holds, and whose likelihoods a scoring task lays out, at once.
BLOCK = 64
#: A declaration is right so often; a host's prior counts like so many pages of the level above.
DECLARED_RIGHT, PRIOR_PAGES = 0.9, 5.0
#: Words beyond so many add no more weight: neighbouring words are not independent evidence.
MOST_WORDS = 200
#: Nats below a page's best text score from which a language is not written. A declaration moves a language by 21 at
#: most, three levels of priors by 3 ln(pages), 84 at a trillion pages: what is left, e ** -45, is below double precision.
MARGIN = 150.0

_HIDDEN = regex.compile(r"(?is)<(script|style|head)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&#?\w+;")


def visible_text(html: str) -> str:
    return _HIDDEN.sub(" ", html)


def _word_buckets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every word."""
    data, offsets = utf8(column)
    data, starts, ends, first = words_of(data, offsets)
    row = np.searchsorted(first, np.arange(len(starts)), side="right") - 1
    hashed = hashing.ranges(hashing.prefix(hashing.TABLE[data]), starts, ends)
    return row, (hashed & np.uint64(BUCKETS - 1)).astype(np.int64)


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """All languages, sorted; where each one's word buckets end; the buckets; their counts over every whole text.

    A task holds the counts of BLOCK languages and writes them when more come; the sums are a
    grouped table. The driver gets the buckets that a language has, not a dense table.
    """
    slim = docs.filter(docs[lang_col].isNotNull()).select(docs[lang_col].cast("string").alias("_lang"), docs[text_col].cast("string").alias("_text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def written() -> pa.RecordBatch:
            at = [np.union1d(np.flatnonzero(x), [0]) for x in held.values()]  # a language without words is one too
            names = pa.array(np.repeat(np.array(list(held), object), [len(x) for x in at]), pa.string())
            n = np.concatenate([x[i] for x, i in zip(held.values(), at)])
            held.clear()
            return pa.RecordBatch.from_arrays([names, pa.array(np.concatenate(at).astype(np.int32)), pa.array(n)], names=["lang", "bucket", "n"])

        for batch in batches:
            for part in chunks(batch, "_text"):
                coded = part.column(0).dictionary_encode()
                own, lang = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
                row, bucket = _word_buckets(part.column(1))
                keys, n = np.unique(lang[row] * BUCKETS + bucket, return_counts=True)
                edges = np.searchsorted(keys, np.arange(len(own) + 1) * BUCKETS)
                for i, name in enumerate(own):
                    if name not in held:
                        if len(held) == BLOCK:
                            yield written()
                        held[name] = np.zeros(BUCKETS, np.int64)
                    held[name][keys[edges[i] : edges[i + 1]] - i * BUCKETS] += n[edges[i] : edges[i + 1]]
        if held:
            yield written()

    ship(docs.sparkSession)
    counts = slim.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    told = counts.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("all")).select("lang", "all.bucket", "all.n").toArrow().sort_by("lang").combine_chunks()
    ends = np.cumsum([0, *(len(x) for x in told.column("bucket"))])
    flat = lambda name, kind: np.concatenate([np.zeros(0, kind), *(x.flatten().to_numpy() for x in told.column(name).chunks)]).astype(kind)
    return told.column("lang").to_pylist(), ends, flat("bucket", np.int16), flat("n", np.int64)


def likelihoods(ends: np.ndarray, buckets: np.ndarray, counts: np.ndarray, first: int, last: int) -> np.ndarray:
    """ln P(word bucket | language) of the languages from first to before last, as languages by BUCKETS."""
    table = np.full((last - first, BUCKETS), 0.5)
    for i in range(first, last):
        table[i - first, buckets[ends[i] : ends[i + 1]]] += counts[ends[i] : ends[i + 1]]
    return np.log(table / table.sum(axis=1, keepdims=True))


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> tuple[list[str], np.ndarray]:
    """Languages, and their likelihoods as one dense table."""
    languages, *model = learn(docs, lang_col, text_col)
    return languages, likelihoods(*model, 0, len(languages))


def identify(pages: DataFrame, docs: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page row: id, `host`, `suffix`, `declared`, `text_lang`, `lang`, `posterior`.

    Every language of docs takes part, however rare. ln P(lang | page) is the sum of the visible words' log-likelihoods (from docs, tempered
    beyond MOST_WORDS words), of the declared language's (right with DECLARED_RIGHT) and of the
    host's prior. A host's prior are its pages' text languages, smoothed by those of its address
    suffix, and these by all pages', each level worth PRIOR_PAGES pages; all by grouped sums.

    Null or empty html: no words, and the other evidence decides. Null url: host and suffix ''.
    Unknown or missing declarations are no evidence. Ties go to the language first in the
    alphabet. Repeated rows count and answer one by one. Without training rows lang is null. An
    empty table gives an empty table.
    """
    languages, *model = learn(docs)
    if not languages:
        none = F.lit(None).cast("string")
        return pages.select(pages[id_col], *[none.alias(x) for x in ("host", "suffix", "declared", "text_lang", "lang")], F.lit(None).cast("double").alias("posterior"))
    n_langs = len(languages)
    held = pages.sparkSession.sparkContext.broadcast(model)
    host = F.lower(F.regexp_extract(F.coalesce(pages[url_col], F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    declared = F.lower(F.regexp_extract(F.coalesce(pages[html_col], F.lit("")), r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([a-z]{2,3})""", 1))
    slim = pages.select(
        pages[id_col].alias("_id"), host.alias("host"), F.regexp_extract(host, r"([^.]+)$", 1).alias("suffix"), declared.alias("declared"), pages[html_col].cast("string").alias("_text")
    )

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        row, bucket = _word_buckets(pa.array([visible_text(x or "") for x in batch.column("_text").to_pylist()], pa.string()))
        words = np.bincount(row, minlength=n)
        temper = np.minimum(1.0, MOST_WORDS / np.maximum(words, 1))
        scores = np.empty((n, n_langs))
        for first in range(0, n_langs, BLOCK):
            last = min(first + BLOCK, n_langs)
            for i, line in enumerate(likelihoods(*held.value, first, last), first):
                scores[:, i] = np.bincount(row, weights=line[bucket], minlength=n) * temper
        top = scores.argmax(axis=1)
        near = scores >= scores.max(axis=1, keepdims=True) - MARGIN
        offsets = np.append(0, np.cumsum(near.sum(axis=1)))
        nos = np.broadcast_to(np.arange(n_langs, dtype=np.int32), near.shape)[near]
        return pa.RecordBatch.from_arrays(
            [*batch.columns[:4], pa.array(top, pa.int32(), mask=words == 0), lists(offsets, pa.array(nos)), lists(offsets, pa.array(scores[near]))],
            names=["_id", "host", "suffix", "declared", "_top", "_nos", "_scores"],
        )

    kind = dict(slim.dtypes)["_id"]
    seen = stage(map_chunks(slim, "_text", f"_id {kind}, host string, suffix string, declared string, _top int, _nos array<int>, _scores array<double>", work), "page-scores")

    counted = stage(seen.groupBy("host", "suffix", "_top").agg(F.count("*").alias("_n")), "page-hosts")
    with_words = counted.filter("_top is not null")
    overall = np.ones(n_langs)
    for x in with_words.groupBy("_top").agg(F.sum("_n").alias("_n")).collect():
        overall[x["_top"]] += x["_n"]
    everywhere = pages.sparkSession.sparkContext.broadcast((languages, overall / overall.sum()))
    one = F.struct("_top", "_n")
    suffixes = with_words.groupBy("suffix", "_top").agg(F.sum("_n").alias("_n")).groupBy("suffix").agg(F.collect_list(one).alias("_s"))
    hosts = counted.groupBy("host", "suffix").agg(F.collect_list(F.when(F.col("_top").isNotNull(), one)).alias("_h"), F.sum("_n").alias("_pages"))
    hosts = stage(hosts, "page-host-counts")
    # most hosts may share one suffix
    held_suffixes = stage(hosts.groupBy("suffix").agg(F.count("*").alias("_hosts")).join(suffixes, "suffix", "left"), "page-suffixes")
    priors = meet(hosts, held_suffixes, ["suffix"], "_hosts").select("host", "suffix", "_pages", "_h._top", F.col("_h._n").alias("_hn"), F.col("_s._top").alias("_st"), F.col("_s._n").alias("_sn"))
    priors = stage(priors.withColumnRenamed("_top", "_ht"), "page-priors")
    return meet(seen, priors, ["host", "suffix"], "_pages").select(
        "_id", "host", "suffix", "declared", "_top", "_nos", "_scores", "_ht", "_hn", "_st", "_sn"
    ).mapInArrow(_fuse(everywhere), f"`{id_col}` {kind}, host string, suffix string, declared string, text_lang string, lang string, posterior double")


def _fuse(everywhere):
    """Texts' scores, declarations and priors of joined page rows, as languages and posteriors."""

    def dense(nos: pa.Array, values: pa.Array, n: int, width: int, rest: float) -> np.ndarray:
        out = np.full((n, width), rest)
        row = np.repeat(np.arange(n), pc.list_value_length(nos).fill_null(0).to_numpy(zero_copy_only=False))
        out[row, nos.flatten().to_numpy()] = values.flatten().to_numpy()
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, share = everywhere.value
        number, width, names = {x: i for i, x in enumerate(languages)}, len(languages), pa.array(languages, pa.string())
        wrong = max((1 - DECLARED_RIGHT) / max(1, width - 1), 1e-9)
        for batch in batches:
            for start in range(0, batch.num_rows, max(1, (1 << 20) // width)):
                part = batch.slice(start, max(1, (1 << 20) // width))
                n = part.num_rows
                total = dense(part.column("_nos"), part.column("_scores"), n, width, -np.inf)
                told = np.array([number.get(x, -1) for x in part.column("declared").to_pylist()], np.int64)
                known = np.flatnonzero(told >= 0)
                total[known] += np.log(wrong)
                total[known, told[known]] += np.log(DECLARED_RIGHT) - np.log(wrong)
                of_suffix = dense(part.column("_st"), part.column("_sn"), n, width, 0.0)
                above = (of_suffix + PRIOR_PAGES * share) / (of_suffix.sum(axis=1, keepdims=True) + PRIOR_PAGES)
                of_host = dense(part.column("_ht"), part.column("_hn"), n, width, 0.0)
                total += np.log((of_host + PRIOR_PAGES * above) / (of_host.sum(axis=1, keepdims=True) + PRIOR_PAGES))
                lang = total.argmax(axis=1)
                posterior = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                out = [*part.columns[:4], names.take(part.column("_top")), names.take(pa.array(lang)), pa.array(posterior)]
                yield pa.RecordBatch.from_arrays(out, names=["_id", "host", "suffix", "declared", "text_lang", "lang", "posterior"])

    return run
