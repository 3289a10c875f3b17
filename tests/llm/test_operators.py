"""Each operator against a plain version on a small table of awkward texts."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from tidemark.llm import common, decontaminate, language, lines, packing, quality, queries, secrets, simhash, tokens, toxicity, windows

BLANK = "\t\n\x0b\x0c\r "


def sha(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def same(found, expected):
    assert sorted(map(repr, found)) == sorted(map(repr, expected))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_quality(spark, docs, rows, empty):
    trusted = spark.createDataFrame([(i * 3,) for i in range(9, 40)], "id long")
    found = quality.digest(quality.score(docs, trusted)).collect()
    expected = []
    for doc_id, text, *_ in rows:
        w = words(text)
        grams, covered = Counter(zip(w, w[1:], w[2:])), set()
        for i in range(len(w) - 2):
            if grams[w[i], w[i + 1], w[i + 2]] > 1:
                covered |= {i, i + 1, i + 2}
        seen, dup = set(), 0
        for line in (text or "").split("\n"):
            if words(line):
                dup += line in seen
                seen.add(line)
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        expected.append((doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), failed))
    same([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found], expected)
    assert all((r.llr is None) == (r.n_words == 0) and (not r.kept or not r.base_failed) for r in found)
    scored = quality.score(docs, trusted)
    assert scored.filter("kept and n_words > 0").count() == sum(r.kept for r in found)  # filters move freely
    assert "clash" in [r._text for r in scored.collect()]
    assert quality.score(empty, trusted).count() == 0
    assert {r.llr for r in quality.score(docs, trusted.limit(0)).filter("n_words > 0").collect()} == {0.0}


def plain_verdicts(texts, trusted, smoothing=1.0):
    """llr of each text from hashed words and pairs, as Spark's xxhash64 has them."""
    long = lambda x: (x - (1 << 64) if x >> 63 else x).to_bytes(8, "little", signed=True)
    hashed = [[xxhash.xxh64_intdigest(w.encode(), 42) for w in words(t)] for t in texts]
    pair = lambda a, b: xxhash.xxh64_intdigest(long(b), xxhash.xxh64_intdigest(long(a), 42))
    grams = [[x % quality.BUCKETS for x in [*h, *(pair(a, b) for a, b in zip(h, h[1:]))]] for h in hashed]
    n, t = Counter(g for x in grams for g in x), Counter(g for x, k in zip(grams, trusted) if k for g in x)
    all_n, all_t = sum(n.values()) + smoothing * quality.BUCKETS, sum(t.values()) + smoothing * quality.BUCKETS
    ratio = lambda g: round(np.log((t[g] + smoothing) / all_t) - np.log((n[g] + smoothing) / all_n), 4)
    return [np.mean([ratio(g) for g in x]) if x else None for x in grams]


@pytest.mark.parametrize("most", [4_000_000, 3])
def test_quality_verdicts(spark, docs, rows, monkeypatch, most):
    monkeypatch.setattr(quality, "BROADCAST_IDS", most)
    trusted = {i * 3 for i in range(9, 40)}
    found = {(r.doc_id, r.text): r for r in quality.score(docs, spark.createDataFrame([(k,) for k in trusted] + [(None,)], "id long")).collect()}
    for (doc_id, text, *_), llr in zip(rows, plain_verdicts([x[1] for x in rows], [x[0] in trusted for x in rows])):
        r = found[doc_id, text]
        assert (r.llr is None) == (llr is None) and (llr is None or r.llr == pytest.approx(llr, abs=1e-9))
        assert r.kept == (not r.base_failed and llr is not None and llr >= quality.THRESHOLD)


def test_texts_above_a_chunk(spark):
    """Texts longer than what a task works on at once: prose, a single word, many lines."""
    r = random.Random(12)
    vocabulary = ["".join(r.choice("abcdefghijklmnoprstu") for _ in range(r.randint(3, 11))) for _ in range(5000)]
    prose = lambda n: " ".join(r.choices(vocabulary, k=n))
    passage = prose(400)
    texts = [f"{prose(90_000)} {passage} {prose(60_000)}", f"{passage} tail", "x" * 1_200_000, "\n".join(f"line {i % 60_000} {i % 7}" for i in range(100_000)), "small", None]
    assert all(len(texts[i]) > common.CHUNK_BYTES for i in (0, 2, 3))
    table = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string").repartition(2)
    by_id = lambda df: [tuple(x) for x in df.orderBy("doc_id").collect()]
    found = windows.remove_repeated_windows(table, with_text=False)
    assert by_id(found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) == [(i, *x) for i, x in enumerate(plain_windows(texts, 200))]
    found = lines.drop_common_lines(table, min_docs=2)
    keys = Counter(k for t in texts for k in {x.strip(BLANK) for x in (t or "").split("\n")} if k)
    left = [[x for x in (t or "").split("\n") if not (x.strip(BLANK) and keys[x.strip(BLANK)] >= 2)] for t in texts]
    assert by_id(found.select("doc_id", "n_lines", "kept_text")) == [(i, (t or "").count("\n") + 1, "\n".join(x)) for i, (t, x) in enumerate(zip(texts, left))]
    assert by_id(quality.score(table, table.select("doc_id").limit(0)).select("doc_id", "n_words")) == [(i, len(words(t))) for i, t in enumerate(texts)]
    assert by_id(simhash.near_duplicates(table).select("doc_id", "fingerprint")) == [(i, f"{plain_print(t):016x}") for i, t in enumerate(texts)]
    ids = [ids_of(t, 0) for t in texts]
    got = by_id(tokens.read_ids(tokens.write_ids(table, queries.TOKENIZER, end_id=0)).select("doc_id", "n_tokens", "ids_crc32"))
    assert got == [(i, len(x), zlib.crc32(x.tobytes())) for i, x in enumerate(ids)]
    pieces = packing.pack(table, queries.TOKENIZER, end_id=0, with_ids=True).orderBy("doc_id", "start").collect()
    assert [b"".join(bytes(x.ids) for x in pieces if x.doc_id == i) for i in range(len(texts))] == [x.tobytes() for x in ids]
    item = spark.createDataFrame([(1, " ".join(passage.split()[:30]))], "item_id long, text string")
    assert [x[2] for x in by_id(decontaminate.digest(decontaminate.find_hits(table, item)))] == [30, 30, 0, 0, 0, 0]
    assert secrets.scan(table).count() == 6 and toxicity.score(table, spark.createDataFrame([(1, 1), (4, 0)], "doc_id long, toxic int")).count() == 6


def test_quality_ratio_by_hand(spark):
    docs = spark.createDataFrame([(1, "good good text"), (2, "bad worse"), (3, "good text")], "doc_id long, text string")
    trusted = spark.createDataFrame([(1,), (3,)], "doc_id long")
    score = {r.doc_id: r.llr for r in quality.score(docs, trusted).collect()}
    assert score[1] > score[2] and score[3] > score[2]
    grams = lambda t: words(t) + list(zip(words(t), words(t)[1:]))
    corpus = Counter(g for t in ("good good text", "bad worse", "good text") for g in grams(t))
    good = Counter(g for t in ("good good text", "good text") for g in grams(t))
    n, t, b = sum(corpus.values()), sum(good.values()), quality.BUCKETS
    by_hand = np.mean([np.log((good[g] + 1) / (t + b)) - np.log((corpus[g] + 1) / (n + b)) for g in grams("bad worse")])
    assert score[2] == pytest.approx(by_hand, abs=1e-3)


def plain_windows(texts, size):
    count = Counter(hash(b[i : i + size]) for t in texts for b in [(t or "").encode()] for i in range(len(b) - size + 1))
    out = []
    for t in texts:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if count[hash(b[i : i + size])] > 1:
                gone[i : i + size] = b"\1" * size
        kept = bytes(x for x, y in zip(b, gone) if not y)
        out.append((len(b), sum(gone), sum(1 for i, x in enumerate(gone) if x and (not i or not gone[i - 1])), sha(kept)))
    return out


@pytest.mark.parametrize("size, gram", [(200, 64), (40, 12)])
def test_windows(spark, docs, rows, empty, monkeypatch, size, gram):
    monkeypatch.setattr(common, "HOT_KEYS", 2000 if size == 200 else 30)
    r = random.Random(size)
    base = "".join(r.choice("abcdé ") for _ in range(1500))
    pieces = []
    for i in range(30):
        s = r.randint(0, 1400)
        t = "".join(r.choice("xyz") if r.random() < 0.01 else c for c in base[s : s + r.randint(0, 300)])
        pieces.append((1000 + i, t + "".join(r.choice("mnopq") for _ in range(r.randint(0, 60)))))
    table = docs.select("doc_id", "text").union(spark.createDataFrame(pieces, "doc_id long, text string"))
    every = [(x[0], x[1]) for x in rows] + pieces
    found = windows.remove_repeated_windows(table, size=size, gram=gram).collect()
    same([(x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in found], [(k, *v) for (k, _), v in zip(every, plain_windows([t for _, t in every], size))])
    assert all(sha(bytes(x.kept)) == x.kept_sha256 for x in found)
    if size == 40:
        assert windows.remove_repeated_windows(empty, size=size, gram=gram).count() == 0


def test_filters_fold_within_bounds():
    import tracemalloc

    r = np.random.default_rng(3)
    keys = r.integers(0, 2**63, 3000, dtype=np.uint64)
    place = keys & np.uint64((1 << windows.FILTER_BITS) - 1)
    words = {}
    for p in place.tolist():
        words[p >> 6] = words.get(p >> 6, 0) | 1 << (p & 63)
    seen = windows.Seen.__new__(windows.Seen)
    seen.bitmap = windows.folded(np.array(list(words)), np.array(list(words.values()), np.uint64))
    seen.mask = np.uint64(8 * len(seen.bitmap) - 1)
    assert seen.passes(keys).all() and len(seen.bitmap) < 16_384 and seen.passes(r.integers(0, 2**63, 10_000, dtype=np.uint64)).mean() < 0.1
    full = np.full(1 << (windows.FILTER_BITS - 6), 2**64 - 1, np.uint64)  # every bit set
    tracemalloc.start()
    assert len(windows.folded(np.arange(len(full)), full)) == 1 << (windows.FILTER_BITS - 3)
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()


def test_lines(docs, rows, empty):
    found = lines.drop_common_lines(docs, min_docs=10)
    key = lambda x: x.strip(BLANK).translate({c: c + 32 for c in range(65, 91)})
    count = Counter(k for x in rows for k in {key(y) for y in (x[1] or "").split("\n")} if k)
    expected = []
    for doc_id, text, *_ in rows:
        all_lines = (text or "").split("\n")
        kept = [y for y in all_lines if not (key(y) and count[key(y)] >= 10)]
        expected.append((doc_id, len(all_lines), len(all_lines) - len(kept), "\n".join(kept)))
    same([(r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in found.collect()], expected)
    assert any(e[2] for e in expected) and "clash" in [r._text for r in found.collect()]
    assert lines.drop_common_lines(empty).count() == 0


def test_meet_finds_every_pair_of_hot_and_other_keys(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_KEYS", 5)
    rows = [(i, 0 if i % 2 else i % 40, i % 3) for i in range(400)] + [(999, None, 1)]
    table = [(k, 1, 200 if k == 0 else 10) for k in range(0, 30)]
    left, right = spark.createDataFrame(rows, "i int, k int, j int"), spark.createDataFrame(table, "k int, j int, n long")
    found = common.meet(left, right, ["k", "j"], "n").select("i", "k", "j", "n").collect()
    same([tuple(r) for r in found], [(i, k, j, n) for i, k, j in rows for k2, j2, n in table if (k, j) == (k2, j2)])
    assert common.meet(left, right.limit(0), ["k", "j"], "n").count() == 0
    every = common.meet(left, right, ["k", "j"], "n", "left").select("i", "k", "j", "n").collect()
    weights = {(k, j): n for k, j, n in table}
    same([tuple(r) for r in every], [(i, k, j, weights.get((k, j))) for i, k, j in rows])


def test_secrets(docs, rows, empty):
    kinds = [("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6), ("access", re.compile("(AKIA[A-Z0-9]+)"), 1, 20), ("hex", re.compile("([0-9a-f]+)"), 1, 24)]
    long = re.compile("[A-Za-z0-9+/_=-]{20,}")
    spans, owners = [], defaultdict(set)
    for doc_id, text, _, owner, *_ in rows:
        base = [(m.start(), no, m.end(), kind, m.group(g)) for no, (kind, p, g, least) in enumerate(kinds) for m in p.finditer(text or "") if len(m.group(g)) >= least]
        free = [(m.start(), 3, m.end(), "owned", m.group()) for m in long.finditer(text or "") if re.search("[0-9]", m.group()) and re.search("[A-Za-z]", m.group()) and len(set(m.group())) >= 10 and not any(b[0] < m.end() and m.start() < b[2] for b in base)]
        spans.append((doc_id, base, free))
        for x in base + free:
            owners[x[4]].add(owner)
    show = lambda xs: ",".join(f"{x[3]}:{x[0]}:{x[2]}" for x in sorted(xs))
    expected = [(k, *[sum(x[1] == no for x in b) for no in range(3)], sha(show(b)), show(b + [x for x in f if len(owners[x[4]]) == 1])) for k, b, f in spans]
    found = secrets.digest(secrets.scan(docs)).collect()
    same([tuple(r)[:6] for r in found], expected)
    assert any("owned" in r.spans for r in found) and sum(r.n_assign for r in found) >= 1
    assert secrets.scan(empty).count() == 0


def test_secret_verdicts_use_documents_and_owners(spark):
    hot, token, two, one, three = "password=hotvalue1", "Ab3dE5gH7jK9mN1pQ3sT5v", "password=twoowners", "password=oneowner", "password=threeowners"
    rows = [(i, f"{hot} x {token}", "a") for i in range(5)] + [(10, two, "a"), (11, two, "b"), (12, one, "a")] + [(20 + i, three, x) for i, x in enumerate("abc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r.doc_id: (r.n_live, r.n_example, "owned" in r.spans) for r in secrets.digest(secrets.scan(docs, example_documents=5)).collect()}
    assert found[0] == (0, 1, False)  # one owner, many documents
    assert found[10] == found[11] == (1, 0, False)  # two owners: shared, but live
    assert found[12] == (1, 0, False) and found[20] == (0, 1, False)
    found = {r.doc_id: (r.n_live, r.n_example, "owned" in r.spans) for r in secrets.digest(secrets.scan(docs, example_documents=6)).collect()}
    assert found[0] == (1, 0, True)


def test_secrets_of_a_dump_of_keys(spark):
    import time

    n = 20_000
    lines = [f"secret=value{i:08d}x\n" for i in range(n)]
    docs = spark.createDataFrame([(1, "".join(lines), "a"), (2, "none", "a"), (3, "Ab3dE5gH7jK9mN1pQ3sT5v " * 2000 + "token=abcdefg", "b")], "doc_id long, text string, source string")
    began = time.time()
    found = {r.doc_id: r for r in secrets.scan(docs).collect()}
    assert time.time() - began < 60
    assert found[1].n_assign == n and [(x.start, x.end) for x in found[1].base] == [(i * 22, i * 22 + 21) for i in range(n)]
    assert len(found[3].spans) == 2001 and [x.start for x in found[3].spans] == [23 * i for i in range(2001)] and found[2].spans == []


def test_language(spark):
    train = spark.createDataFrame([("the cat and the dog of house", "en"), ("el gato y la casa de perro", "es"), (None, "en"), ("zzz", None)], "text string, lang string")
    page = lambda i, url, lang, text: (i, url, None if text is None else f"<html{f' lang={lang}' if lang else ''}><style>la la la</style><p>{text}</p>")
    pages = [page(1, "http://a.com/1", "en", "the cat of the house"), page(2, "http://a.com/2", "en", "la casa y el gato"), page(3, "http://b.es/x", "", "gato y perro"), page(4, "http://b.es/y", "", "qqq"), page(5, "http://b.es/z", "xx", None), page(6, None, "es", "qqq"), (7, None, None)]
    pages += [page(10 + i, "http://b.es/", "", "el perro de la casa") for i in range(6)]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    found = {r.page_id: r for r in language.identify(table, train).collect()}
    assert len(found) == len(pages) and all(0 < r.posterior <= 1 for r in found.values())
    assert [found[i].lang for i in (1, 2, 3, 4, 6)] == ["en", "es", "es", "es", "es"]
    assert found[5].text_lang is None and found[5].lang == "es" and found[7].host == ""
    # the same sums in plain Python
    langs, logs = language.train(train)
    assert langs == ["en", "es"]
    hosts, tops = defaultdict(lambda: np.zeros(2)), {}
    score = {}
    for i, url, html in pages:
        import pyarrow as pa

        row, bucket = language._word_buckets(pa.array([language.visible_text(html or "")]))
        score[i] = logs[:, bucket].sum(axis=1)
        host = (url or "").split("/")[2] if url else ""
        tops[i] = (host, int(score[i].argmax()) if len(bucket) else None)
        if len(bucket):
            hosts[host][tops[i][1]] += 1
    everywhere = (sum(hosts.values()) + 1) / (sum(hosts.values()).sum() + 2)
    for i, url, html in pages:
        suffix = tops[i][0].rpartition(".")[2]
        of_suffix = sum((v for k, v in hosts.items() if k.rpartition(".")[2] == suffix), np.zeros(2))
        above = (of_suffix + 5 * everywhere) / (of_suffix.sum() + 5)
        prior = (hosts[tops[i][0]] + 5 * above) / (hosts[tops[i][0]].sum() + 5)
        told = re.search("<html lang=(en|es)>", html or "")
        declared = np.array([0.9 if x == told[1] else 0.1 for x in langs]) if told else np.ones(2)
        total = score[i] + np.log(declared) + np.log(prior)
        p = np.exp(total - total.max())
        assert found[i].lang == langs[int(total.argmax())] and found[i].posterior == pytest.approx(1 / p.sum())
    assert language.identify(table.limit(0), train).count() == 0
    assert language.identify(table, train.limit(0)).filter("lang is null").count() == len(pages)


def test_language_of_hot_hosts_and_suffixes(spark, monkeypatch):
    train = spark.createDataFrame([("the cat and the dog", "en"), ("el gato y la casa", "es")], "text string, lang string")
    r = random.Random(4)
    pages = [(i, f"http://h{i % 37 if i % 3 else 0}.{'com' if i % 5 else 'es'}/", "<p>" + " ".join(r.choice(["the", "cat", "el", "gato", "casa"]) for _ in range(i % 7))) for i in range(200)]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    plain = [tuple(x) for x in language.identify(table, train).collect()]
    monkeypatch.setattr(common, "HOT_KEYS", 3)
    same([tuple(x) for x in language.identify(table, train).collect()], plain)


def test_language_keeps_every_language(spark):
    names = [f"{a}{b}" for a in "abcdefghij" for b in "abcdefghijklm"]  # 130, the last ones in one document each
    rows = [(f"{x}word {x}term {x}name", x) for i, x in enumerate(names) for _ in range(2 if i < 100 else 1)] + [(None, "zz")]
    train = spark.createDataFrame(rows, "text string, lang string")
    pages = [(i, f"http://h{i}.org/", f"<html><p>{x}term {x}word {x}name {x}word") for i, x in enumerate(names)] + [(999, "http://zz.org/", '<html lang="zz">')]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    found = {r.page_id: r for r in language.identify(table, train).collect()}
    assert len(language.train(train)[0]) == 131 and len(found) == len(pages)
    assert [found[i].lang for i in range(len(names))] == names and [found[i].text_lang for i in range(len(names))] == names
    assert found[999].lang == found[999].declared == "zz"


def ids_of(text, end):
    from tokenizers import Tokenizer

    ids_of.tokenizer = getattr(ids_of, "tokenizer", None) or Tokenizer.from_file(queries.TOKENIZER)
    return np.array([*ids_of.tokenizer.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_encoder_equals_library():
    enc = tokens.Encoder(queries.TOKENIZER)
    r = random.Random(7)
    for _ in range(3000):
        text = "".join(r.choice(["a", "bc", "'s", " ", "\n", "\t", "1", "é", "!", "\xa0", "\x1c", "'", "ll", "　", "Z", "-", "<|endoftext|>"]) for _ in range(r.randint(0, 12)))
        assert enc.encode(text) == ids_of(text, 0)[:-1].tobytes(), repr(text)


def test_encoder_equals_library_on_every_character():
    enc = tokens.Encoder(queries.TOKENIZER)
    of = lambda c: f"a{c}'s{c}1 {c}"
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    odd = [c for c in every if enc.odd.search(c)]
    assert odd and all(enc.encode(of(c)) == ids_of(of(c), 0)[:-1].tobytes() for c in odd)
    plain = [c for c in every if not enc.odd.search(c)]
    for i in range(0, len(plain), 4096):
        text = "\n".join(map(of, plain[i : i + 4096]))
        assert enc.encode(text) == ids_of(text, 0)[:-1].tobytes(), hex(ord(plain[i]))
    for text in ("end\u0558's", "a\u088f's done", "x\ua7ce't"):
        assert enc.encode(text) == ids_of(text, 0)[:-1].tobytes()


@pytest.mark.parametrize("bits", [1, 3, 8, 13, 16, 17, 21, 32])
def test_bits_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 999, dtype=np.uint64).astype("<u4")
    assert (tokens.unpack(tokens.pack(ids, bits), bits, 999) == ids).all()


def test_token_files(spark, docs, rows, empty):
    manifest = tokens.write_ids(docs, queries.TOKENIZER, end_id=0)
    found = sorted(tokens.read_ids(manifest).collect(), key=lambda r: r.start)
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    expected, start = [], 0
    for doc_id, text, *_ in order:
        ids = ids_of(text, 0)
        expected.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert [tuple(r) for r in found] == expected
    row = max(manifest.collect(), key=lambda r: r.n_ids)
    with tokens._open(row.path, "r") as file:  # any range, by its blocks alone
        reader = tokens.ShardReader(file)
        every = reader.ids(0, reader.n_ids)
        for a, b in ((0, 1), (5, 5), (4095, 4097), (4000, 9000), (reader.n_ids - 1, reader.n_ids)):
            assert (reader.ids(a, b) == every[a:b]).all()
    assert tokens.read_ids(tokens.write_ids(empty, queries.TOKENIZER, end_id=0)).count() == 0
    named = [(f"é{i % 7}-{i}" if i else None, f"text {i}") for i in range(40)]
    table = spark.createDataFrame(named, "doc_id string, text string").repartition(3)
    found = tokens.read_ids(tokens.write_ids(table, queries.TOKENIZER, end_id=0)).orderBy("start").collect()
    order = sorted(named, key=lambda x: (x[0] is not None, (x[0] or "").encode()))
    assert [(r.doc_id, r.n_tokens) for r in found] == [(k, len(ids_of(t, 0))) for k, t in order]


def item_words(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


@pytest.mark.parametrize("block", [1_000_000, 3])
def test_decontamination(spark, docs, rows, empty, block):
    benchmark = [(1, " ".join(words(rows[8][1])[20:60])), (2, "Two, WORDS"), (10, "two words"), (3, None), (4, "..."), (None, " ".join(words(rows[6][1])[:13])), (7, "not there at all")]
    table = spark.createDataFrame(benchmark, "item_id long, text string")
    by_window = defaultdict(set)
    for k, t in benchmark:
        w = item_words(t)
        for i in range(max(1, len(w) - 12)):
            if w:
                by_window[tuple(w[i : i + 13])].add("" if k is None else str(k))
    expected = []
    for doc_id, text, *_ in rows:
        w, hit, items = item_words(text), set(), set()
        for n in {len(x) for x in by_window}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in by_window:
                    hit |= set(range(i, i + n))
                    items |= by_window[tuple(w[i : i + n])]
        expected.append((doc_id, len(w), len(hit), len(items), sha(",".join(sorted(items))), bool(hit) and 20 * len(hit) >= len(w)))
    found = decontaminate.find_hits(docs, table, block_windows=block)
    same([tuple(r) for r in decontaminate.digest(found).collect()], expected)
    assert any(e[5] for e in expected)
    kept = decontaminate.remove_contaminated(docs, table)
    same([tuple(r) for r in kept.collect()], [x for x, e in zip(rows, expected) if not e[5]])
    assert decontaminate.find_hits(empty, table).count() == 0 and decontaminate.find_hits(docs, table.limit(0)).filter("n_hit > 0").count() == 0


def test_one_block_of_the_benchmark_is_held_at_a_time(spark, docs, monkeypatch):
    import gc
    import weakref

    alive, most = weakref.WeakSet(), []

    plain = decontaminate.Windows.__init__

    def counted(self, items):
        plain(self, items)
        gc.collect()
        alive.add(self)
        most.append(len(alive))

    monkeypatch.setattr(decontaminate.Windows, "__init__", counted)
    table = spark.createDataFrame([(i, f"word{i} of an item") for i in range(60)], "item_id long, text string")
    decontaminate.find_hits(docs, table, block_windows=10)
    assert len(most) == 6 and max(most) <= 2


def plain_print(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def plain_groups(prints, radius=4):
    distinct = sorted(set(prints))
    root = {p: p for p in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= radius and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {p: find(p) for p in distinct}


@pytest.mark.parametrize("hot", [2000, 4])
def test_hot_fingerprints_and_roots(spark, monkeypatch, hot):
    """A third of the rows are one text, another third one group; with HOT_KEYS small, both are broadcast."""
    monkeypatch.setattr(common, "HOT_KEYS", hot)
    r = random.Random(9)
    words_ = [f"w{i}" for i in range(60)]
    base = [r.choice(words_) for _ in range(400)]
    near = lambda: " ".join(x if r.random() > 0.004 else "odd" for x in base)
    texts = [""] * 60 + [near() for _ in range(60)] + [" ".join(r.choice(words_) for _ in range(200)) for _ in range(60)]
    found = simhash.digest(simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6))).collect()
    prints = [plain_print(t) for t in texts]
    group, least = plain_groups(prints), {}
    for i, p in enumerate(prints):
        least.setdefault(group[p], i)
    same([tuple(x) for x in found], [(i, f"{p:016x}", least[group[p]]) for i, p in enumerate(prints)])
    star = [(0, i) for i in range(1, 200)] + [(1000 + i, 1001 + i) for i in range(40)]
    joined = {x._node: x._root for x in simhash.components(spark.createDataFrame(star, "_u long, _v long")).collect()}
    assert len({joined[i] for i in range(200)}) == 1 and len({joined[1000 + i] for i in range(41)}) == 1 and len(joined) == 241


def test_simhash(docs, rows, empty):
    prints = [plain_print(x[1]) for x in rows]
    group = plain_groups(prints)
    least = {}
    for x, p in zip(rows, prints):
        if x[0] is not None:
            least[group[p]] = min(least.get(group[p], x[0]), x[0])
    for tile in (8192, 5):
        found = simhash.digest(simhash.near_duplicates(docs, tile=tile)).collect()
        same([tuple(r) for r in found], [(x[0], f"{p:016x}", least.get(group[p])) for x, p in zip(rows, prints)])
    kept = simhash.keep_one(docs).collect()
    assert len(kept) == len(set(group.values())) and {group[plain_print(r.text)] for r in kept} == set(group.values())
    assert {r.doc_id for r in kept if r.doc_id is not None} == set(least.values())
    assert simhash.near_duplicates(empty).count() == 0


def test_tiles_find_every_link(spark):
    r = random.Random(3)
    prints = set()
    for _ in range(150):
        a = r.getrandbits(64)
        prints.add(a)
        for _ in range(3):  # chains of close neighbours
            for b in r.sample(range(64), r.randint(1, 6)):
                a ^= 1 << b
            prints.add(a)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    table = spark.createDataFrame(signed, "_fp long")
    expected = plain_groups(prints)
    for tile, group in ((4096, None), (37, None), (37, 3)):
        joined = simhash.components(simhash.near_links(table, len(prints), 4, tile, group)).collect()
        found = defaultdict(set)
        for x in joined:
            found[x._root].add(x._node & (1 << 64) - 1)
        big = defaultdict(set)
        for p, g in expected.items():
            big[g].add(p)
        same([sorted(x) for x in found.values()], [sorted(x) for x in big.values() if len(x) > 1])


@pytest.mark.parametrize("shape", ["rising", "falling", "star", "comb"])
def test_rounds_follow_the_logarithm(spark, monkeypatch, shape):
    n = 1024
    links = {"rising": [(i, i + 1) for i in range(n)], "falling": [(-i, -i - 1) for i in range(n)], "star": [(n, i) for i in range(n)], "comb": [(i, i + 2) for i in range(n)] + [(0, 1)]}[shape]
    rounds = []
    plain = simhash.stage
    monkeypatch.setattr(simhash, "stage", lambda df, name: rounds.append(name) or plain(df.coalesce(1), name))
    found = simhash.components(spark.createDataFrame(links, "_u long, _v long").coalesce(1)).collect()
    assert {x._node for x in found} == {x for link in links for x in link} and len({x._root for x in found}) == 1
    assert rounds.count("groups") <= 16


def test_toxicity(spark, empty):
    r = random.Random(2)
    base = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(1500):
        toxic = r.random() < 0.15
        w = [r.choice(base) for _ in range(60)] + [r.choice(["vile", "scumbag", "idiotic"]) for _ in range(3 if toxic else 0)]
        r.shuffle(w)
        rows.append((i, " ".join(w)))
        if r.random() < 0.5:
            labels.append((i, int(toxic)))
    rows += [(None, None), (9000, ""), (9001, "vile scumbag idiotic")]
    labels += [(None, 1), (5, None)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    found = {x.doc_id: x for x in toxicity.score(docs, marks).collect()}
    assert len(found) == len(rows) and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.3) for x in found.values())
    assert all(x.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k, x in found.items() if k is not None)
    told = {k: v for k, v in labels if k is not None and v is not None}
    held = [(found[k].predicted, v) for k, v in told.items() if found[k].held_out]
    assert sum(p == v for p, v in held) >= 0.95 * len(held) and sum(p and v for p, v in held) >= 0.9 * sum(v for _, v in held)
    # held-out labels change nothing
    flipped = spark.createDataFrame([(k, 1 - v if k is not None and v is not None and found[k].held_out else v) for k, v in labels], "doc_id long, toxic int")
    assert {x.doc_id: x.score for x in toxicity.score(docs, flipped).collect()} == {k: x.score for k, x in found.items()}
    assert toxicity.score(empty, marks).count() == 0
    assert {x.score for x in toxicity.score(docs, marks.filter("toxic = 0")).collect()} == {0.0}


@pytest.mark.parametrize("shift", [0.0, -4.0])
def test_risk_and_its_gradients(shift):
    r = np.random.default_rng(6)
    z_p, z_u, prior = r.normal(size=7) - shift, r.normal(size=11) + shift, 0.4
    by_hand = lambda a, b: (prior * np.mean([np.log1p(np.exp(-x)) for x in a]), np.mean([np.log1p(np.exp(x)) for x in b]) - prior * np.mean([np.log1p(np.exp(x)) for x in a]))
    plus, minus, g_p, g_u = toxicity.risk(z_p, z_u, prior)
    assert (plus, minus) == pytest.approx(by_hand(z_p, z_u)) and (minus < 0) == (shift < 0)  # both branches
    target = (lambda a, b: sum(by_hand(a, b))) if minus >= 0 else (lambda a, b: -by_hand(a, b)[1])
    step = lambda z, i, e: z + e * (np.arange(len(z)) == i)
    assert g_p == pytest.approx([(target(step(z_p, i, 1e-5), z_u) - target(step(z_p, i, -1e-5), z_u)) / 2e-5 for i in range(7)], abs=1e-7)
    assert g_u == pytest.approx([(target(z_p, step(z_u, i, 1e-5)) - target(z_p, step(z_u, i, -1e-5))) / 2e-5 for i in range(11)], abs=1e-7)


def test_toxicity_features_are_of_all_documents(spark, monkeypatch):
    r = random.Random(8)
    rows, labels = [], []
    for i in range(4000):
        toxic = i % 4 == 0
        slur = f"slur{i // 4 % 1300 if i // 4 < 400 else i // 4 % 40}" if toxic else "calm"
        rows.append((i, " ".join([r.choice(["ab", "cd", "ef", "gh", "ij"]) for _ in range(20)] + [slur])))
        labels.append((i, int(toxic)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "choose", lambda *a: seen.append(a) or np.flatnonzero(a[0]))
    outside = [k for k, v in labels if zlib.crc32(str(k).encode()) % 4 != 2]
    for table in (docs, docs.union(docs.filter("doc_id % 8 = 0"))):  # repeated ids: each row is counted
        seen.clear()
        toxicity.train(table, marks)
        df_p, n_p, df_u, n_u, _ = seen[0]
        again = [k for k in outside if k % 8 == 0] if table is not docs else []
        assert n_u == len(outside) + len(again) and n_p == sum(k % 4 == 0 for k in outside) + len(again)
        assert df_u.max() <= n_u and (df_p <= df_u).all()
    seen.clear()
    assert toxicity.train(docs.union(docs), marks, most_positive=100, most_unlabelled=100) is not None
    assert seen[0][1] > 100 and seen[0][3] > 100  # the sample does not bound the counts
    # no fixed number of features
    df_p = np.zeros(1 << toxicity.BITS, np.int64)
    df_p[:3000] = 50
    monkeypatch.undo()
    assert len(toxicity.choose(df_p, 4000, df_p, 100_000, 0.1)) == 3000


def test_packing(docs, rows, empty):
    found = packing.pack(docs, queries.TOKENIZER, end_id=1, length=128, with_ids=True).collect()
    expected = Counter((x[0], ids_of(x[1], 1).tobytes()) for x in rows)
    pieces = defaultdict(list)
    for r in found:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
        pieces[r.sequence_id].append(r)
    flat = []  # documents again, in the order of the sequences
    for s in sorted(pieces):
        at = 0
        for r in sorted(pieces[s], key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
            flat.append(r)
        assert at <= 128
    whole, held = Counter(), b""
    for r in flat:
        assert len(held) == 4 * r.start
        held += bytes(r.ids)
        if len(held) == 4 * r.doc_tokens:
            whole[r.doc_id, held] += 1
            held = b""
    assert whole == expected and held == b""
    assert sum(sum(r.length for r in p) < 128 for p in pieces.values()) <= 4
    assert packing.pack(empty, queries.TOKENIZER).count() == 0


def test_hilbert_curve_is_continuous():
    side = 8
    points = np.array([(x, y, z) for x in range(side) for y in range(side) for z in range(side)])
    keys = packing.hilbert_key(points, 3)
    assert sorted(keys.tolist()) == list(range(side**3))
    path = points[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()
