"""Each stage of the pipeline on its own input against a plain version, and the whole run."""

from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from test_operators import BLANK, ids_of, item_words, plain_groups, plain_print

from tidemark.llm import quality, queries


@pytest.fixture(scope="module")
def sf(spark, rows, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('sf')}"
    r = __import__("random").Random(4)
    vocabulary = [f"{a}{b}" for a in "clear plain calm broad fine open still near far good".split() for b in ("", "ly", "er", "ing", "s")]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    clean = [prose(r.randint(60, 200)) for _ in range(40)]
    passage = prose(40)
    texts = [*clean, clean[0], clean[1], clean[2].replace(clean[2].split()[5], "changed", 1), passage + " " + prose(60), "x " + prose(50)]
    texts += [f"{prose(70)}\nAll Rights  Reserved\n{prose(20)}" for _ in range(11)]
    texts += ["### $$$ *** " * 40, "too short", None, ""]
    table = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate([*texts, *[x[1] for x in rows]])]
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = [tuple(r) for r in docs.collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near dedup", "decontamination", "packing"]

    judged = {r.doc_id: r.kept for r in quality.score(docs, queries.trusted(spark, sf)).collect()}
    kept = stages["quality rules"](spark, docs, sf)
    after = [tuple(r) for r in kept.collect()]
    assert kept.columns == docs.columns and Counter(after) == Counter(x for x in before if judged[x[0]])
    assert {x[0] for x in after} >= set(range(40))  # clean documents stay

    kept = stages["line dedup"](spark, kept, sf)
    key = lambda x: x.strip(BLANK).translate({c: c + 32 for c in range(65, 91)})
    count = Counter(k for x in after for k in {key(y) for y in x[1].split("\n")} if k)
    expected = []
    for x in after:
        left = [y for y in x[1].split("\n") if not (key(y) and count[key(y)] >= 10)]
        text = "\n".join(left)
        if left == x[1].split("\n"):
            expected.append(x)
        elif text.strip(" "):
            expected.append((x[0], text, x[2], x[3], len(text)))
    after = [tuple(r) for r in kept.collect()]
    assert Counter(after) == Counter(expected) and any("All Rights" in x[1] for x in before if x[1]) and not any("All Rights" in x[1] for x in after)

    kept = stages["near dedup"](spark, kept, sf)
    prints = {x[0]: plain_print(x[1]) for x in after}
    groups, least = plain_groups(prints.values()), defaultdict(lambda: 10**9)
    for k, p in prints.items():
        least[groups[p]] = min(least[groups[p]], k)
    after = [x for x in after if x[0] in set(least.values())]
    assert Counter(tuple(r) for r in kept.collect()) == Counter(after) and len(after) < len(prints)

    kept = stages["decontamination"](spark, kept, sf)
    w = item_words([r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if r.text][0])
    windows = {tuple(w[i : i + 13]) for i in range(len(w) - 12)}
    bad = set()
    for x in after:
        own = item_words(x[1])
        hit = {j for i in range(len(own) - 12) if tuple(own[i : i + 13]) in windows for j in range(i, i + 13)}
        if hit and 20 * len(hit) >= len(own):
            bad.add(x[0])
    after = [x for x in after if x[0] not in bad]
    assert bad and Counter(tuple(r) for r in kept.collect()) == Counter(after)

    pieces = defaultdict(list)
    for r in stages["packing"](spark, kept, sf).collect():
        pieces[r.doc_id].append((r.start, bytes(r.ids)))
    assert {k: b"".join(x for _, x in sorted(v)) for k, v in pieces.items()} == {x[0]: ids_of(x[1], 1).tobytes() for x in after}
    assert corpus_pipeline.run(spark, sf).count() == sum(map(len, pieces.values()))


def test_line_dedup_keeps_every_document(spark):
    texts = ["common\nlines"] * 12 + ["common\n \nlines", "common\n\nlines", "own words"]
    table = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.line_dedup(spark, docs, "")
    found = {r.doc_id: (r.text, r.n_chars) for r in kept.collect()}
    assert found == {**{i: ("", 0) for i in range(12)}, 12: (" ", 1), 13: ("", 0), 14: ("own words", 9)}
    stay = {r.doc_id for r in corpus_pipeline.near_dedup(spark, kept, "").collect()}
    assert stay == {0, 14}  # near-dedup keeps one of the emptied copies
