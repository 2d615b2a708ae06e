"""The pipeline against a brute-force version of each stage, and run() against the chained stages."""

from __future__ import annotations

import itertools
import random
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from sirenlens.llm import langid, lines
from sirenlens.llm.common import prepared
from tests.llm.test_operators import WORD, grams, groups

LANGS = {
    "aa": ["the", "of", "and", "with", "this", "there", "which", "would"],
    "bb": ["der", "und", "nicht", "mit", "über", "größe", "für", "können"],
}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, size string, _id long"


def prose(rng, lang, n):
    return " ".join(rng.choice(LANGS[lang]) + rng.choice(["", "", "s", "er"]) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    items = [prose(rng, "aa", n) for n in (24, 30)]
    texts = []
    for k in range(120):
        lang = "ab"[k % 2] * 2
        body = "\n".join(prose(rng, lang, rng.randrange(12, 30)) for _ in range(rng.randrange(1, 4)))
        texts.append((("this line stands on every page\n" if k % 3 == 0 else "") + body, lang, "abc"[k % 3]))
    near = texts[7][0].split(" ")
    near[len(near) // 2] = "und"
    texts += [texts[5], texts[5], (" ".join(near), "bb", "a"), (texts[9][0].upper(), "aa", None)]
    texts += [(f"{prose(rng, 'aa', 20)} {item} {prose(rng, 'aa', 9)}", "aa", "b") for item in items]
    texts += [(None, "aa", "a"), ("", None, None), ("12 %% 34", "aa", "b"), (" \n ", None, "c"), (prose(rng, "bb", 60_000), None, "c")]
    rows = [(k, t, lang, s, len(t or ""), 1, "big", 2) for k, (t, lang, s) in enumerate(texts)]
    rows += [rows[11], (None, *rows[13][1:])]
    path = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    bench = [*enumerate(items), (7, None), (8, "")]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def bag(rows):
    return Counter((r.doc_id, r.text) for r in rows)


def boilerplate_cut(rows):
    pages, held = defaultdict(set), defaultdict(set)
    for r in rows:
        if r.text is not None:
            pages[r.source].add(r.text)
            for line in r.text.split("\n"):
                held[r.source, line].add(r.text)
    bad = {
        (s, x) for (s, x), on in held.items()
        if x and len(on) >= lines.LEAST and len(on) > lines.RATIO * len(pages[s])
    }
    return Counter((r.doc_id, "\n".join(x for x in r.text.split("\n") if (r.source, x) not in bad)) for r in rows)


def one_of_each_group(rows):
    found = list(bag(rows))
    sets = [grams(t) for _, t in found]
    links = [
        (a, b) for a, b in itertools.combinations(range(len(found)), 2)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    root, least = groups(len(found), links), {}
    for k, (d, _) in enumerate(found):
        least[root[k]] = min((x for x in (least.get(root[k]), d) if x is not None), default=None)
    return Counter(x for k, x in enumerate(found) if not sets[k] or x[0] == least[root[k]])


def holds(text, item):
    a, b = ([w.lower() for w in (x or "").split()] for x in (text, item))
    if min(len(a), len(b)) < 5:
        return False
    y = Counter(tuple(b[k : k + 5]) for k in range(len(b) - 4))
    for s in range(max(1, len(a) - len(b) + 1)):
        window = a[s : s + len(b)]
        x = Counter(tuple(window[k : k + 5]) for k in range(len(window) - 4))
        if 4 * sum((x & y).values()) >= 3 * sum((x | y).values()):
            return True
    return False


def test_every_stage_and_the_whole(spark, folder):
    docs = prepared(spark).read.parquet(f"{folder}/documents.parquet")
    bench = spark.read.parquet(f"{folder}/benchmark.parquet").collect()
    at, before, columns = docs, docs.collect(), docs.columns
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at, folder)
        path = f"{folder}/{name}"
        out.write.parquet(path)
        at = spark.read.parquet(path)
        rows = at.collect()
        kept[name] = bag(rows)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert at.columns == columns
        if name == "language_id":
            said = langid.predict(docs, langid.train(docs.where(~langid.held_out()))).collect()
            known = {r.doc_id for r in said if r.lang_pred != "und" and r.score >= corpus_pipeline.LEAST_SCORE}
            assert kept[name] == Counter({x: n for x, n in bag(before).items() if x[0] in known})
            assert not any(t is None or not any(map(str.isalpha, t)) for _, t in kept[name])
            assert len(rows) > 0.9 * len(before)
        elif name == "line_dedup":
            assert kept[name] == boilerplate_cut(before)
            assert all(r.n_chars == len(r.text) for r in rows)
        elif name == "near_duplicates":
            assert kept[name] == one_of_each_group(before)
        elif name == "decontamination":
            clean = {x for x in bag(before) if not any(holds(x[1], i.text) for i in bench)}
            assert kept[name] == Counter({x: n for x, n in bag(before).items() if x in clean})
            assert len(clean) == len(bag(before)) - 2
        else:
            size = Counter()
            for r in before:
                size[r.source] += len(WORD.findall(r.text))
            for s in size:
                mine = [r for r in rows if r.source == s]
                assert {r.source_size for r in mine} == {size[s]}
                longest = max(len(WORD.findall(r.text)) for r in before if r.source == s)
                assert abs(sum(r.taken for r in mine) - mine[0].target) <= longest
            assert set(kept[name]) <= set(bag(before)) and max(kept[name].values()) == 1
            assert all(r.taken == r.copies * r.size and 1 <= r.copies <= 2 for r in rows)
        before = rows
    whole = corpus_pipeline.run(spark, folder).collect()
    assert sorted(map(str, whole)) == sorted(map(str, before))


def test_one_document_of_a_group_stays_with_repeated_and_null_ids(spark):
    rng = random.Random(17)
    one, two, three = (prose(rng, "aa", 40) for _ in range(3))
    texts = [(3, one), (3, one + " more"), (4, one + " again"), (None, two), (None, two + " more"), (None, two + " again"), (8, three), (8, three), (8, three), (9, "")]
    rows = [(k, t, "ab"[i % 2], "zyx"[i % 3], 0, 1, "s", 2) for i, (k, t) in enumerate(texts)]
    docs = prepared(spark).createDataFrame(rows, SCHEMA)
    for frame in (docs, docs.orderBy(F.desc("source")).coalesce(1)):
        got = corpus_pipeline.near_duplicates(spark, frame, "").collect()
        assert Counter(r.doc_id for r in got) == {3: 1, None: 1, 8: 1, 9: 1}
        assert [r.text.startswith(one) for r in got if r.doc_id == 3] == [True]
        assert [(r.text, r.source, r.lang) for r in got if r.doc_id == 8] == [(three, "x", "a")]


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(prepared(spark), str(tmp_path)).count() == 0
