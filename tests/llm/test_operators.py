"""The dealt operators on small tables: brute force, round trips, nulls, ties, repeats, empty tables."""

from __future__ import annotations

import base64
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from sirenlens.llm import chat, decontaminate, html, jaccard, langid, lines, mixing, tokens, vectors, warc
from sirenlens.llm.common import components, prepared
from sirenlens.llm.words import words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, host string, h long, key long"


@pytest.fixture(scope="module")
def sp(spark):
    return prepared(spark)


def prose(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "Delta", "eps%", "zeta,", "eta.\n", "ö"]) + str(rng.randrange(40)) for _ in range(n))


def documents(sp, texts, sources=None):
    rows = [(k, t, "en", (sources or ["s"] * len(texts))[k], 0, "x", 1, 2) for k, t in enumerate(texts)]
    return sp.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    base = [prose(rng, n) for n in (60, 200, 30, 7, 4, 1, 900)]
    out = [None, "", " \n\t ", "one", "one", "A b C", "a B c"]
    for text in base:
        for _ in range(6):
            split = text.split(" ")
            for _ in range(rng.randrange(1 + len(split) // 20)):
                split[rng.randrange(len(split))] = f"new{rng.randrange(10**6)}"
            out.append(" ".join(split))
        out += [text, text]
    return [*out, "x" * 300_000]


def grams(text):
    found = [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(text or "")]
    return {tuple(found[k : k + 5]) for k in range(len(found) - 4)} if len(found) >= 5 else ({tuple(found)} if found else set())


def groups(n, links):
    root = list(range(n))
    for _ in range(n):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_words_of_a_batch_do_not_depend_on_their_place():
    one, where = words(pa.array(["a B", None, "b\na", ""]))
    assert where.tolist() == [0, 2, 2, 4, 4]
    assert one[0] == one[3] and one[1] == one[2]
    sliced, _ = words(pa.array(["zz", "a B"]).slice(1))
    assert sliced.tolist() == one[:2].tolist()


def test_components(sp):
    rng = random.Random(1)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(0, k) for k in range(150, 200)]
    got = dict(components(sp.createDataFrame(links, "a long, b long")).collect())
    root = groups(200, links)
    assert got == {k: root[k] for k in {x for a, b in links if a != b for x in (a, b)}}
    assert components(sp.createDataFrame([], "a long, b long")).count() == 0


def test_ngram_jaccard(sp, corpus):
    sets = [grams(t) for t in corpus]
    links = [
        (a, b) for a, b in itertools.combinations(range(len(sets)), 2)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    root = groups(len(sets), links)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(documents(sp, corpus)).collect()}
    assert got == {k: (len(s), root[k]) for k, s in enumerate(sets)}
    assert len(set(root)) < len(root) - 20


def test_ngram_jaccard_null_and_repeated_ids(sp):
    text = "one two three four five six"
    rows = [(None, text), (None, text), (3, text), (3, text), (9, None), (None, None)]
    got = jaccard.near_duplicates(sp.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got if r.n_shingles and r.doc_id) == [(3, 2, 3)] * 2
    assert [r.component_id for r in got if r.n_shingles and r.doc_id is None] == [3, 3]
    assert sorted(str(r.component_id) for r in got if not r.n_shingles) == ["9", "None"]
    assert jaccard.near_duplicates(sp.createDataFrame([], "doc_id long, text string")).count() == 0


def test_token_counts_equal_the_library(sp, corpus, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.tokenizer_path("byte_bpe_50k.json"))
    odd = ["a<|endoftext|>b", " lead", "trail ", "a  b", "a \n b", " x y  z", "x\x1c y", "it's  we'll", "日本 語 ​ x", " ", "  "]
    texts = [t[:5000] if t else t for t in corpus] + odd
    cache = f"file://{tmp_path}/cache"
    for _ in range(2):  # the second time everything is stored
        got = tokens.count_tokens(documents(sp, texts), cache).collect()
        want = {k: len(library.encode(t or "", add_special_tokens=False).ids) for k, t in enumerate(texts)}
        assert {r.doc_id: r.n_tokens for r in got} == want
        assert all(r.n_bytes == len((texts[r.doc_id] or "").encode()) and r.over_limit == (r.n_tokens > 1024) for r in got)
    stored = sp.read.parquet(f"{cache}/tokenizer={tokens.tokenizer_version('byte_bpe_50k.json')}")
    assert stored.count() == len({t or "" for t in texts})
    assert tokens.count_tokens(documents(sp, []), f"{cache}-2").count() == 0


def test_decontamination_finds_every_similar_window(sp):
    rng = random.Random(3)
    items = [prose(rng, n).replace("\n", " ") for n in (20, 33, 33, 58)] + ["too short", None, ""]
    texts = [None, "", prose(rng, 400)]
    for item in items[:4]:
        split = item.split()
        near = [*split]
        near[len(near) // 2] = "changed"
        texts += [prose(rng, 90) + " " + item + " " + prose(rng, 5), item.upper().replace("Ö", "ö"), " ".join(near) + " end", " ".join(split[: len(split) // 2])]
    bench = sp.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = documents(sp, texts)
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contaminated(docs, bench).collect()}
    want = {}
    for (d, t), (i, q) in itertools.product(enumerate(texts), enumerate(items)):
        a, b = ([w.lower() for w in (x or "").split()] for x in (t, q))
        if len(b) < 5 or len(a) < 5:
            continue
        for s in range(max(1, len(a) - len(b) + 1)):
            x, y = ([tuple(w[k : k + 5]) for k in range(len(w) - 4)] for w in (a[s : s + len(b)], b))
            common = sum(min(x.count(g), y.count(g)) for g in set(x))
            score = common / (len(x) + len(y) - common)
            if score >= 0.75:
                want[d, i] = max(score, want.get((d, i), 0))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)
    kept = {r.doc_id for r in decontaminate.without_items(docs, bench).collect()}
    assert kept == set(range(len(texts))) - {d for d, _ in want}
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def test_decontamination_by_several_blocks_equals_one(sp, monkeypatch):
    rng = random.Random(9)
    items = [(k, prose(rng, 12 + k % 9).replace("\n", " ")) for k in range(40)]
    items += items[:5] + [(None, prose(rng, 25)), (3, None), (None, None)]
    texts = [None, "", "w " * 200_000] + [prose(rng, 30)] * 3
    texts += [f"{prose(rng, 20)} {t} {prose(rng, 20)}" for _, t in items[:40:3]] * 2 + [f"{items[1][1]} {items[-3][1]}"]
    docs = documents(sp, texts).withColumn("doc_id", F.when(F.col("doc_id") % 7 != 0, F.col("doc_id")))
    docs = docs.withColumn("_hit_id", F.lit("clash")).withColumn("item_id", F.lit(1)).withColumn("h", F.lit("h"))
    bench = sp.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    found = sorted(map(tuple, decontaminate.contaminated(docs, bench).collect()), key=repr)
    kept = sorted(map(tuple, decontaminate.without_items(docs, bench).collect()), key=repr)
    assert len(found) == 30 and {r[1] for r in found} >= {None, 0, 1}
    assert len(kept) == 6
    monkeypatch.setattr(decontaminate, "ITEMS", 7)
    index, blocks = decontaminate.written_index(bench)
    assert blocks == 6 and index.select("block").distinct().count() > 1
    assert sorted(map(tuple, decontaminate.contaminated(docs, bench).collect()), key=repr) == found
    assert sorted(map(tuple, decontaminate.without_items(docs, bench).collect()), key=repr) == kept
    assert decontaminate.without_items(docs, bench.limit(0)).count() == len(texts)


def test_multi_index_misses_no_fingerprint_within_the_radius():
    rng = np.random.default_rng(2)
    index = decontaminate.Index([1, 2], [prose(random.Random(k), 25).replace("\n", " ") for k in (1, 2)])
    width = len(index.grams[0])
    for distance in (0, 5, decontaminate.RADIUS, decontaminate.RADIUS + 1):
        for _ in range(50):
            flip = sum(1 << int(b) for b in rng.choice(64, distance, replace=False))
            _, found = index.candidates(width, index.prints[:1] ^ np.uint64(flip))
            assert (0 in found.tolist()) == (distance <= decontaminate.RADIUS)


def test_line_dedup(sp):
    texts = [f"menu\nown {k}\n\nown {k}\nmenu" for k in range(12)] + ["copy line"] * 9 + [None, "", "menu"]
    sources = ["a"] * 12 + ["a"] * 9 + ["a", None, None]
    got = {r.doc_id: r for r in lines.drop_boilerplate(documents(sp, texts, sources), host="source").collect()}
    assert got[0].text == "own 0\n\nown 0" and (got[0].n_lines, got[0].n_dropped) == (5, 2)
    assert got[12].text == "copy line"  # copies of one page are one page
    assert got[21].text is None and got[22].text == "" and got[23].text == "menu"  # another site
    assert got[0].n_chars == 0 and got[0].host == "x"
    assert lines.drop_boilerplate(documents(sp, []), host="source").count() == 0


def test_line_dedup_of_large_and_small_sites(sp):
    long = " ".join(f"word{k}" for k in range(60))
    texts = [f"own {k}" + ("\nRights" if k < 4 else "\n" + long if k < 8 else "\ntwice" if k < 10 else "") for k in range(500)]
    texts += [f"page {k}\nmenu" for k in range(3)] + ["left\nboth", "right\nboth"]
    sources = ["large"] * 500 + ["small"] * 3 + ["pair"] * 2
    got = {r.doc_id: r.text for r in lines.drop_boilerplate(documents(sp, texts, sources), host="source").collect()}
    assert [got[k] for k in range(8)] == [f"own {k}" for k in range(8)]  # 4 of 500 pages
    assert got[8] == "own 8\ntwice" and [got[500 + k] for k in range(3)] == ["page 0", "page 1", "page 2"]
    assert got[503] == "left\nboth"  # two pages that share text can be near copies


def test_mixing(sp):
    rng = random.Random(4)
    texts = [" ".join(["w"] * rng.randrange(1, 60)) for _ in range(5000)] + [None, "", "a " * 30_000]
    sources = [rng.choice(["a", "b", "b", "c", "B", None]) for _ in texts]
    rows = mixing.mix_to_targets(documents(sp, texts, sources)).collect()
    again = mixing.mix_to_targets(documents(sp, texts, sources)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again)) and len(rows) == len(texts)
    size = {s: sum(len(WORD.findall(t or "")) for t, x in zip(texts, sources) if x == s) for s in set(sources)}
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    total, target, free = 1.5 * sum(size.values()), {}, set(order)
    while True:
        left = total - sum(target.values())
        level = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if level[s] > 2 * size[s]}
        if not over:
            target |= level
            break
        target |= {s: 2.0 * size[s] for s in over}
        free -= over
    for s in order:
        mine = [r for r in rows if r.source == s]
        assert all(abs(r.target - target[s]) < 1e-6 and r.source_size == size[s] for r in mine)
        assert abs(sum(r.taken for r in mine) - target[s]) <= max(r.size for r in mine)
    assert all(0 <= r.taken <= 2 * r.size and r.size == len(WORD.findall(texts[r.doc_id] or "")) for r in rows)
    assert mixing.mix_to_targets(documents(sp, [])).count() == 0


def test_pivotal_rounding_keeps_words_and_expectations():
    rng = random.Random(6)
    size, p = [3, 8, 1, 20, 5, 5], [0.3, 0.5, 0.9, 0.25, 0.6, 0.6]
    hits = np.zeros(6)
    for _ in range(20_000):
        done, at, a = mixing.pair_off(size, p, [rng.random() for _ in size])
        kept = [d if d >= 0 else a for d in done]
        assert abs(np.dot(kept, size) - np.dot(p, size)) < 1e-9 and done.count(-1) <= 1
        hits += kept
    assert np.abs(hits / 20_000 - p).max() < 0.02


def test_node_keeps_expectations_of_short_and_long_documents():
    rng = np.random.default_rng(12)
    n, runs = 344, 250
    for p, copies in ((0.6, 1), (0.1, 1), (0.3, 2)):  # equal rows have one key and one draw
        size = rng.choice([10, 200, 3000], n // copies, p=[0.45, 0.45, 0.1]).repeat(copies)
        hits, rows = np.zeros(3), np.array([(size == k).sum() for k in (10, 200, 3000)])
        for _ in range(runs):
            key = rng.integers(-(2**63), 2**63, n // copies).repeat(copies)
            draw = rng.random(n // copies).repeat(copies)
            group = pd.DataFrame({"doc_id": 1, "source": "s", "key": key, "size": size, "whole": 0, "p": p, "draw": draw, "lot": rng.random(n)})
            out = mixing._node(True)(group)
            hits += [out["copies"][out["size"] == k].sum() for k in (10, 200, 3000)]
            assert abs((out["copies"] * out["size"]).sum() - p * size.sum()) <= 3000
        assert np.abs(hits / (runs * rows) - p).max() < 0.01


def test_chat_round_trip(sp):
    said = ["</s>[INST] ok [/INST]", "\\", "\\\\[", "<s>", "", "plain\ntext", "[INST user]", "]" * 50_000]
    rows = [(1, k, ("user", "assistant", "system", "a]b\\")[k % 4], t) for k, t in enumerate(said)]
    rows += [(None, 1, None, None), (2, None, "assistant", "b"), (2, None, "assistant", "a"), (2, 0, "assistant", "a")]
    out = chat.format_conversations(sp.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    texts = {r.conv_id: r for r in out.collect()}
    assert chat.read_turns(texts[1].formatted) == [(r[2], r[3]) for r in rows[: len(said)]]
    assert chat.read_turns(texts[None].formatted) == [("", "")]
    got = {r.conv_id: r for r in chat.digests(out).collect()}
    assert got[2].n_turns == 3 and got[2].loss_sha256 == hashlib.sha256(b"aba").hexdigest()
    assert got[1].loss_chars == sum(len(t) for k, t in enumerate(said) if k % 4 == 1)


def test_template_language():
    source = '{% set x = "a" + "b" %}{% for m in messages %}{% if loop.first and not m.skip %}{{ x | upper }}{% elif m.role in "user" %}u{% else %}{{ m["role"] }}{% endif %}{% endfor %}{% if 1 == 2 %}never{% endif %}'
    render = chat.compile_template(source)
    assert render({"messages": [{"role": "q"}, {"role": "user"}, {"role": "z"}]}) == ("ABuz", [])
    assert chat.fold(chat.parse('a{{ "b" + "c" | upper }}{% if true %}d{% endif %}')) == [("text", "abCd")]
    assert chat.compile_template("x{% generation %}yz{% endgeneration %}")({}) == ("xyz", [(1, 3)])
    assert chat.compile_template("{{ m.__class__ }}{{ m.real }}")({"m": 3}) == ("", [])
    for wrong in ("{{ a( }}", "{% if a %}", "{% import os %}", "{{ a | exec }}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(wrong)


def test_warc_round_trip(sp, tmp_path):
    rng = random.Random(7)
    body = ["".join(rng.choice("abc<>é\n") for _ in range(rng.randrange(4000))) for _ in range(40)]
    pages = [(k, f"http://h/{k}?a b", body[k % 40]) for k in range(90)] + [(200, None, None), (201, "é", ""), (None, "n", body[0])]
    frame = sp.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    for split in (700, 1 << 20):
        files = warc.write_archives(frame, f"file://{tmp_path}/w{split}")
        rows = warc.read_archives(files, split).collect()
        got = {r.page_id: r for r in rows}
        assert len(rows) == len(pages)
        for page_id, _, text in pages:
            payload = (text or "").encode()
            r = got[page_id]
            first = min(p for p, _, t in pages if p is not None and (t or "") == (text or ""))
            assert r.payload_bytes == len(payload)
            assert r.payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
            assert (r.record_type, r.refers_to) == (("response", None) if page_id == first else ("revisit", first))
    assert warc.read_archives(warc.write_archives(frame.limit(0), f"file://{tmp_path}/none")).count() == 0


def test_warc_magic_inside_a_member_is_no_record(tmp_path):
    inner = warc.record(5, "u", b"x" * 50, 50, "D", None)
    fake = zlib.compressobj(0, zlib.DEFLATED, 31)
    stored = fake.compress(b"WARC/1.1\r\nwarc-type: response\r\ncontent-length: 0\r\n\r\n" + warc.MAGIC * 9) + fake.flush()
    (tmp_path / "f").write_bytes(warc.MAGIC + b"junk" + stored + inner)
    with pa.OSFile(str(tmp_path / "f")) as file:
        total = file.size()
        whole = list(warc.records_in(file, 0, total))
        parts = [r for a in range(total) for r in warc.records_in(file, a, a + 1)]
    assert len(whole) == 2 and whole == parts


def test_main_text(sp):
    article = '<!DOCTYPE html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><ul><li>Menu</ul></nav><div class="cookie-notice"><div>x</div>We use</div><article><h1>Head &amp; line</h1><p><b>One<br>two&nbsp; three<p>four</p><aside>see</aside><form>mail</form><script>var a="</p>";</script></article><section id="comments"><p>first!</p></section><footer>&copy; me</footer>'
    plain = "<body><p>Welcome</p><p>Story {}</p><div>All rights</div>"
    rows = [(1, "http://a/x/1", article), (2, "http://b/x/1", plain.format(1)), (3, "http://b/x/2", plain.format(2)),
            (4, "http://b/y", plain.format(3)), (5, None, None), (6, "http://b/x/2", ""), (7, "http://c/", plain.format(4)),
            (None, "bad", "<p>cut off <a hre")]
    got = {r.page_id: r for r in html.main_text(sp.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect()}
    assert got[1].text == "Head & line\nOne two three\nfour"
    assert got[5].text == "" and got[6].text == "" and got[7].text == "Welcome\nStory 4\nAll rights"
    assert got[None].text == "cut off" and got[1].n_chars == len(got[1].text)
    assert html._difference(["Welcome", "Story 1", "All rights"], ["Welcome", "Story 2", "All rights"]) == ["Story 1"]
    a, b = list("abcabba"), list("cbabac")
    picked = html.common_lines(a, b)
    assert len(picked) == 4 and picked == sorted(picked)


def test_pages_without_an_article_do_not_depend_on_cuts_or_copies(sp):
    rng = random.Random(13)
    rows = []
    for k in range(160):
        host, kind = rng.choice("abc"), rng.randrange(7)
        story = "" if kind == 0 else f"<p>Same</p>" if kind < 4 else f"<p>Story {k}</p><p>Both {k % 5}</p>"
        page = f"<p>Welcome {host}</p>{story}<p>End</p>"
        rows.append((k, f"http://{host}/{rng.choice('xyz')}/{rng.randrange(30)}", f"<article>{page}</article>" if kind == 6 else page))
    rows += [(900 + k, "http://a/x/15", "<p>Welcome a</p><p>Same</p><p>End</p>") for k in range(40)]  # a run over several ranges
    rows += [(990, "http://d/1", "<p>Welcome d</p><p>One</p>"), (991, "http://d/1", "<p>Welcome d</p><p>One</p>"), (992, "http://d/2", "<article>A</article>"),
             (993, "http://d/3", "<p>Welcome d</p><p>Three</p>"), (994, "http://e/1", "<p>Welcome a</p>")]
    read = [(i, u, *html.page_lines(t)) for i, u, t in rows]
    free = sorted((u.split("/")[2], "/" + u.split("/", 3)[3], i, out) for i, u, inside, out in read if not inside)
    want = {i: "\n".join(inside) for i, _, inside, _ in read if inside}
    for k, (host, path, i, mine) in enumerate(free):
        sides = (reversed(free[:k]), free[k + 1 :])
        near = [p for side in sides for p in [next((p for p in side if p[0] == host and p[3] != mine), None)] if p]
        best = max(near, key=lambda p: html._alike(p[1], path), default=None)
        want[i] = "\n".join(html._difference(mine, best[3]) if best else mine)
    assert [want[i] for i in (990, 991, 993, 994)] == ["One", "One", "Three", "Welcome a"]
    frame = sp.createDataFrame(rows, "page_id long, url string, html string")
    before = sp.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 7, 61):
            sp.conf.set("spark.sql.shuffle.partitions", n)
            assert {r.page_id: r.text for r in html.main_text(frame).collect()} == want
    finally:
        sp.conf.set("spark.sql.shuffle.partitions", before)
    assert html.main_text(frame.limit(0)).count() == 0


def test_language_id(sp):
    rng = random.Random(8)
    vocabulary = {"aa": "the of and with this there".split(), "bb": "der und nicht mit über größe".split()}
    rows = [(k, " ".join(rng.choice(vocabulary[g]) for _ in range(rng.randrange(1, 30))), g) for k, g in enumerate(["aa", "bb"] * 60)]
    rows += [(500, None, "aa"), (501, "123 %% !", "aa"), (502, "", None), (None, "und über der", None), (503, "ü" * 5000, None)]
    got = langid.identify(sp.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    want = {k: g for k, _, g in rows[:120]}
    assert all(r.lang_pred == want[r.doc_id] for r in got if r.doc_id in want and r.held_out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert {(r.lang_pred, r.score) for r in got if r.doc_id in (500, 501, 502)} == {("und", 0.0)}
    assert all(0 <= r.score <= 1 for r in got) and len(got) == len(rows)
    assert langid.identify(sp.createDataFrame([(1, "a", None)], "doc_id long, text string, lang string")).first().lang_pred == "und"


def test_forward_sums_all_segmentations():
    vocabulary = langid.Pieces()
    prob = np.random.default_rng(0).random((len(vocabulary.pieces), 2)) / 1000
    number = {p: k for k, p in enumerate(vocabulary.pieces)}

    def brute(word):
        if not word:
            return np.ones(2)
        return sum((prob[number[word[:k]]] * brute(word[k:]) for k in range(1, min(len(word), langid.LONGEST) + 1) if word[:k] in number), np.zeros(2))

    data = np.frombuffer("the über x".encode(), np.uint8)
    got = langid.log_words(vocabulary, prob, data, np.array([0, 4, 10]), np.array([3, 9, 11]))
    assert np.allclose(got, np.log([brute(w.encode()) for w in (" the", " über", " x")]))


def test_vectors(sp):
    rng = np.random.default_rng(9)
    centre = rng.standard_normal((6, 40))
    x = [centre[k % 6] + rng.standard_normal(40) * s for k, s in enumerate(rng.choice([0.05, 0.2, 0.3, 1.0], 150))]
    rows = [(k, v.tolist(), int(k % 3 == 0)) for k, v in enumerate(x)]
    rows += [(200, rows[0][1], rows[0][2]), (201, [v * 7 for v in rows[0][1]], rows[0][2]), (202, None, 1), (203, [0.0] * 40, 1),
             (204, [float("nan")] * 40, 1), (205, [None] * 40, 1), (206, rows[0][1], None), (207, [1.0], 1), (208, [], 1), (209, [float("inf")] * 40, 1)]
    got = {r.vec_id: r for r in vectors.near_vectors(sp.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    able = [r for r in rows if r[2] is not None and r[0] not in (202, 203, 204, 205, 207, 208, 209)]
    links = []
    for a, b in itertools.combinations(able, 2):
        p, q = np.array(a[1]), np.array(b[1])
        if a[2] == b[2] and p @ q / np.sqrt((p @ p) * (q @ q)) >= 0.93:
            links.append((a[0], b[0]))
    root = groups(210, links)
    for r in rows:
        k = r[0]
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (sum(k in pair for pair in links), root[k], root[k] == k)
    assert vectors.near_vectors(sp.createDataFrame([], "vec_id long, embedding array<double>, label int")).count() == 0


def test_pigeonhole_tiles_of_a_full_cell(sp, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.standard_normal(16) + rng.standard_normal((90, 16)) * 0.3
    monkeypatch.setattr(vectors, "SIDE", 7)
    rows = [(k, v.tolist(), 1) for k, v in enumerate(x)]
    got = {r.vec_id: r.n_links for r in vectors.near_vectors(sp.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert got == {k: int((u @ u[k] >= 0.93).sum()) - 1 for k in range(90)}
