"""Language identification against a plain version of its own: markup by the standard parser, words by identity, sums in loops."""

import math
import random
import re
from collections import Counter, defaultdict
from html.parser import HTMLParser

import pytest

from tidemark.llm import common, language

BUCKETS, DECLARED, PAGES, MOST = 8192, 0.9, 5.0, 200
VOCABULARY = {"en": "the cat and dog of house we run".split(), "es": "el gato y perro la casa corre años".split(), "de": "der hund und haus über wir laufen die".split(), "rare": ["zu", "wo"]}


class Visible(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.out, self.hidden = [], []

    def handle_starttag(self, tag, attributes):
        self.out.append(" ")
        if tag in ("script", "style", "head"):
            self.hidden.append(tag)

    def handle_endtag(self, tag):
        self.out.append(" ")
        if self.hidden and self.hidden[-1] == tag:
            self.hidden.pop()

    def handle_data(self, data):
        self.out.append(" " if self.hidden else data)

    def handle_entityref(self, name):
        self.out.append(" ")

    handle_charref = handle_entityref


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def seen(html):
    parser = Visible()
    parser.feed(html or "")
    parser.close()
    return words("".join(parser.out))


def plain(pages, docs):
    counts = defaultdict(Counter)
    for text, lang in docs:
        if lang is not None:
            counts[lang].update(words(text))
    langs = sorted(counts)
    p = lambda w, lang: math.log((counts[lang][w] + 0.5) / (sum(counts[lang].values()) + 0.5 * BUCKETS))
    rows = []
    for i, url, html in pages:
        found = seen(html)
        temper = min(1.0, MOST / max(1, len(found)))
        score = {x: temper * sum(p(w, x) for w in found) for x in langs}
        host = (re.match(r"[A-Za-z]+://([^/:?#]+)", url or "") or [None, ""])[1].lower()
        rows.append((i, host, host.rpartition(".")[2], html or "", score, max(langs, key=lambda x: score[x]) if found else None))
    hosts, suffixes, every = defaultdict(Counter), defaultdict(Counter), Counter({x: 1 for x in langs})
    for _, host, suffix, _, _, top in rows:
        if top is not None:
            hosts[host, suffix][top] += 1
            suffixes[suffix][top] += 1
            every[top] += 1
    share = {x: every[x] / sum(every.values()) for x in langs}
    for i, host, suffix, html, score, top in rows:
        declared = (re.search(r"""<html[^>]*\blang="([a-z]+)""", html) or [None, None])[1]
        total = {}
        for x in langs:
            above = (suffixes[suffix][x] + PAGES * share[x]) / (sum(suffixes[suffix].values()) + PAGES)
            prior = (hosts[host, suffix][x] + PAGES * above) / (sum(hosts[host, suffix].values()) + PAGES)
            told = 0.0 if declared not in langs else math.log(DECLARED if declared == x else (1 - DECLARED) / (len(langs) - 1))
            total[x] = score[x] + told + math.log(prior)
        best = max(langs, key=lambda x: total[x])
        yield i, top, best, 1 / sum(math.exp(v - total[best]) for v in total.values())


def made(seed, n):
    r = random.Random(seed)
    docs = [(" ".join(r.choice(VOCABULARY[x]) for _ in range(r.randint(0, 40))), x) for x in ("en", "es", "de") for _ in range(30)] + [("zu zu wo", "rare"), (None, "en"), ("text", None)]
    pages = []
    for i in range(n):
        own = r.choice(["en", "es", "de"])
        body = " ".join(r.choice(VOCABULARY[own if r.random() < 0.8 else "en"]) + r.choice(["", ".", "&amp;", "<b>x</b>", " 7 "]) for _ in range(r.choice([0, 1, 3, 30, 300])))
        tag = r.choice(["<html>", f'<html lang="{own}">', '<html lang="es">', '<html lang="xx">', ""])
        page = f"{tag}<head><title>gato gato</title></head><body class='perro'><!-- der der --><script>the the</script><STYLE>la</STYLE><p>{body}</p></body>"
        pages.append((i, r.choice([None, "http://a.com/x", "https://b.com:8/", "http://c.es?q", "http://d.de#e", "not a url"]), r.choice([page] * 9 + [None, ""])))
    return pages, docs


def compare(spark, pages, docs):
    table, train = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3), spark.createDataFrame(docs, "text string, lang string")
    found = {x.page_id: (x.text_lang, x.lang, x.posterior) for x in language.identify(table, train).collect()}
    expected = {x[0]: x[1:] for x in plain(pages, docs)}
    assert found.keys() == expected.keys()
    for i, (top, best, posterior) in expected.items():
        assert found[i][:2] == (top, best) and found[i][2] == pytest.approx(posterior, abs=1e-6), i


@pytest.mark.parametrize("seed", [1, 2])
def test_languages(spark, seed):
    compare(spark, *made(seed, 120))


def test_pages_and_texts_above_a_chunk(spark):
    pages, docs = made(3, 30)
    r = random.Random(8)
    long = " ".join(r.choice(VOCABULARY["de"]) for _ in range(600_000))
    assert len(long) > 2 * common.CHUNK_BYTES
    compare(spark, [*pages, (500, "http://x.com/", f"<html><p>{long}</p>")], [*docs, (long, "de"), (long[: len(long) // 2], "en")])
