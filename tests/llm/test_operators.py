"""Corpus operators against brute force and on edge cases."""

import hashlib
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from colonnade.llm import common, embedding_join, fingerprint, html_extract, line_dedup, minhash, mixing, packing, pii, quality, toxicity

DIR = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{DIR}/labels.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, repeats, ties, a very long text and clashing extra columns."""
    long = " ".join(f"w{i % 977}x" for i in range(60_000))
    rows = [(1, "a b c d e"), (1, "a b c d e"), (2, None), (3, ""), (None, "x y"), (4, " \n\t "), (5, long), (6, long + " z"), (7, "ÀÉ ﬁ"), (7, "other")]
    return spark.createDataFrame([(i, t, None if k % 3 == 0 else f"s{k % 2}", k, k, "c") for k, (i, t) in enumerate(rows)], "doc_id long, text string, source string, rank int, sid int, a string")


# ---- 1


def _texts(page):
    text = html_extract.extract(page, 1, frozenset())[0]
    return text.split("\n\n") if text else []


def test_html():
    page = """<!doctype html><html><head><title>T</title></head><body><header>Site</header><nav><p>menu</p></nav>
    <aside>side</aside><article><h1>Head &amp; tail</h1><p>One <b>bold</b>&nbsp;word<br>next <button>go</button><p>Two<ul><li>x<li>y</ul>
    <div class="advert">buy</div><form>name</form><script>"<p>no</p>"</script></article>
    <section id="comments"><article class="comment">nice</article></section><footer>end</footer>"""
    assert _texts(page) == ["Head & tail", "One bold word next", "Two", "x", "y"]
    assert _texts("") == [] and _texts("<p") == []
    assert _texts("1 < 2 &lt; 3") == ["1 < 2 < 3"]
    assert _texts("<p>a</p>" + "<div>" * 3000 + "deep") == ["a", "deep"]
    assert _texts("<div><table><tr><td>a<td>b<tr><td>c</table>d<p>e<span hidden>z</span>f") == ["a", "b", "c", "d", "ef"]


@pytest.mark.parametrize("made", [lambda n: "<div>a" * n, lambda n: "<div>" * n + "</p>" * n, lambda n: "<b class=x>" + "<div>" * n + "</b>" * n, lambda n: "(<x \"'>)" * n, lambda n: "<table>" * n + "<tr><td>" * n])
def test_html_parses_in_linear_time(made):
    took = []
    for n in (10_000, 160_000):  # up to a page of about a megabyte
        at = time.perf_counter()
        html_extract.extract(made(n), 1, frozenset([1]))
        took.append(time.perf_counter() - at)
    assert took[1] < 64 * took[0] + 1  # quadratic time would give 256


def test_html_templates(spark):
    rows = [(i, f"https://h.example/{i}", f"<body><div><p>Sign up for offers</p></div><div><p>Story {i}</p><p>all about {i}</p></div></body>", 1) for i in range(12)]
    rows += [(50, "https://other.example/", "<body><p>Sign up for offers</p></body>", 1), (51, None, None, 1), (51, None, "", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host int").selectExpr("*", "1 as key", "2 as slot", "'x' as template")
    got = {(r.page_id, r.url): r for r in html_extract.extract_main_text(df, min_share=0.5).collect()}
    assert all((got[i, u].text, got[i, u].n_template_blocks, got[i, u].n_rule_blocks) == (f"Story {i}\n\nall about {i}", 1, 0) for i, u in ((i, f"https://h.example/{i}") for i in range(12)))
    assert got[50, "https://other.example/"].text == "Sign up for offers" and got[51, None].text == "" and len(got) == 14
    assert html_extract.extract_main_text(df.limit(0)).collect() == []


def _site(r, pages):
    """Pages of two hosts with rotating unmarked menus and footers, and passages that articles share."""
    rows, shared = [], [f"Quoted passage {k} of many words" for k in range(3)]
    for i in range(pages):
        host = "ab"[int(r.integers(0, 10) == 0)]
        menu = "".join(f"<li>menu {int(k)}</li>" for k in r.integers(0, 3, 2))
        inner = "".join(f"<p>own words {i} {k} and more of them</p>" for k in range(int(r.integers(2, 5)))) + (f"<p>{shared[int(r.integers(0, 3))]}</p>" if r.random() < 0.4 else "")
        foot = "" if r.random() < 0.2 else f"<div><p>legal {int(r.integers(0, 5))}</p></div>"
        rows.append((i, f"http://{host}.example/{i}", f"<body><div class='top{i}'><ul>{menu}</ul></div><div class=text>{inner}</div>{foot}</body>"))
    return rows


@pytest.mark.parametrize("broadcast", [True, False])
def test_html_templates_by_brute_force(spark, monkeypatch, broadcast):
    import re as _re
    from xml.etree import ElementTree

    if not broadcast:
        monkeypatch.setattr(html_extract, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(html_extract, "SALT_PAGES", 40)
    rows = _site(np.random.default_rng(4), 160)
    held = {}  # host -> slot -> subtree -> pages
    trees = {}
    for i, url, page in rows:
        tree = ElementTree.fromstring(_re.sub(r"class='?(\w+)'?", r'class="\1"', page))
        trees[i] = (url[7], tree)

        def walk(e, path):
            name = _re.sub("[0-9]", "", e.get("class") or "")
            path = (*path, (e.tag, name))
            if e.tag != "body":
                what = ElementTree.tostring(_plain(e))
                held.setdefault(url[7], {}).setdefault(path, {}).setdefault(what, set()).add(i)
            for c in e:
                walk(c, path)

        def _plain(e):
            out = ElementTree.Element(e.tag)
            out.text = e.text
            out.extend(_plain(c) for c in e)
            return out

        walk(tree, ())
    drop = set()
    for host, slots in held.items():
        own = {path: sum(len(ElementTree.fromstring(w).text or "") for w in whats) for path, whats in slots.items()}
        content = max(own, key=own.get)
        for path, whats in slots.items():
            again = sum(len(p) for p in whats.values() if len(p) >= 3)
            if path != content and again and again >= 0.8 * sum(len(p) for p in whats.values()):
                drop |= {(host, w) for w, p in whats.items() if len(p) >= 3}

    def kept(host, e, gone=False):
        gone = gone or (e.tag != "body" and (host, ElementTree.tostring(_plain(e))) in drop)
        return ([e.text] if e.text and not gone else []) + [t for c in e for t in kept(host, c, gone)]

    got = {r.page_id: r for r in html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {i: r.text for i, r in got.items()} == {i: "\n\n".join(kept(*t)) for i, t in trees.items()}
    assert any(h == "a" for h, _ in drop) and sum(r.n_template_blocks for r in got.values()) > 300 and all("Quoted" in r.text for r in got.values() if "Quoted" in rows[r.page_id][2])


# ---- 2


def _links(ids, x):
    x = x / np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    label = np.array(ids)
    for _ in ids:
        label = np.minimum(label, np.where(near, label[None], 1 << 60).min(axis=1))
    return {i: (int(near[k].sum()), int(label[k])) for k, i in enumerate(ids)}


@pytest.mark.parametrize("pivots, kind", [(1, "double"), (9, "float"), (9, "double")])
def test_embeddings(spark, monkeypatch, pivots, kind):
    monkeypatch.setattr(common, "LEAST_HOT", 2 if kind == "float" else 2000)
    r = np.random.default_rng(1)
    x = np.repeat(r.normal(size=(6, 8)), 80, axis=0) + r.normal(size=(480, 8)) * 0.18
    x = np.vstack([x, x[:50], x[:20] * 3, np.repeat(x[:1], 9, axis=0)])
    if kind == "float":
        x = x.astype("f4").astype(float)
    monkeypatch.setattr(embedding_join, "BLOCK", 60)
    real = embedding_join.choose_pivots
    monkeypatch.setattr(embedding_join, "choose_pivots", lambda s, n: real(s, pivots))
    rows = [(i, [float(v) for v in row], 0) for i, row in enumerate(x)]
    bad = [(9000, None, 1), (9001, [0.0] * 8, 1), (9002, [1.0, float("nan")], 2), (None, [1.0] * 8, 1), (9005, [], 3), (9006, [None, 1.0], 3)]
    df = spark.createDataFrame([*rows, *bad, (9003, [1.0, 2.0], 1), (9004, [2.0, 4.0], 1)], f"vec_id long, embedding array<{kind}>, cell int").selectExpr("*", "1 as vec", "2 as mult", "3 as cid")
    got = {q[0]: (q[1], q[2], q[3]) for q in embedding_join.link_embeddings(df).collect()}
    want = _links(range(len(x)), x)
    assert {k: v[:2] for k, v in got.items() if k in want} == want
    assert got[9003] == (1, 9003, True) and got[9004] == (1, 9003, False)
    assert all(got[b[0]] == (0, b[0], True) for b in bad)
    assert embedding_join.link_embeddings(df.limit(0)).collect() == []


def test_pairs_at_the_limit():
    r = np.random.default_rng(4)
    x = embedding_join._unit(r.normal(size=(700, 24)))
    turn = embedding_join._unit(r.normal(size=x.shape))
    turn = embedding_join._unit(turn - (turn * x).sum(1, keepdims=True) * x)
    angle = np.arccos(0.95) + r.choice([-1e-3, -1e-6, -1e-8, -1e-11, 1e-11, 1e-8, 1e-6, 1e-3], 700)
    y = embedding_join._unit(np.cos(angle)[:, None] * x + np.sin(angle)[:, None] * turn)
    want = np.einsum("ij,kj->ik", x, y) >= 0.95
    got = np.zeros_like(want)
    got[embedding_join.near_pairs(x, y, x.astype("f4"), y.astype("f4"), 0.95)] = True
    assert (got == want).all() and want.any() and not want.diagonal().all()


@pytest.mark.parametrize("same", [True, False])
def test_linked_by_brute_force(monkeypatch, same):
    monkeypatch.setattr(embedding_join, "TILE", (7, 11))
    r = np.random.default_rng(5)
    x = embedding_join._unit(r.normal(size=(60, 3)))
    y = x if same else embedding_join._unit(r.normal(size=(45, 3)))
    mx, owned_x = r.integers(1, 4, 60), r.random(60) < 0.6
    my, owned_y = (mx, owned_x) if same else (r.integers(1, 4, 45), r.random(45) < 0.6)
    ids = r.permutation(60 if same else 105) * 3
    hit = ((x @ y.T) >= 0.9) & (owned_x[:, None] | owned_y[None, :])
    if same:
        np.fill_diagonal(hit, False)
    low = ids.copy()
    for _ in ids:
        for i, j in zip(*np.nonzero(hit), strict=True):
            j = j if same else 60 + j
            low[i] = low[j] = min(low[i], low[j])
    a, b, least = embedding_join.linked(x, y, mx, my, ids, same, owned_x, owned_y, 0.9)
    assert (a == hit @ my).all() and (b == (a if same else mx @ hit)).all() and (least == low).all()


# ---- 3


@pytest.mark.parametrize("range_rows", [16_384, 30])
def test_packing(spark, docs, odd, monkeypatch, range_rows):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "RANGE_ROWS", range_rows)
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    clash = odd.selectExpr("*", "1 as uid", "2 as length", "'x' as sequence_id", "0 as what")
    for df in (docs, clash):
        got = packing.pack_documents(df).toPandas()
        want = []
        for i, t in df.select("doc_id", "text").collect():
            ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
            for k in range(0, len(ids), 4096):
                part = np.array(ids[k : k + 4096], "<u4")
                want.append((i, k // 4096, k, len(part), zlib.crc32(part.tobytes())))
        seen = [(None if np.isnan(r[0]) else int(r[0]), *r[1:]) for r in got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)]
        assert Counter(want) == Counter(seen)
        placed = got.sort_values(["sequence_id", "offset"])
        assert (placed.groupby("sequence_id").length.cumsum() - placed.length == placed.offset).all()
        assert placed.groupby("sequence_id").length.sum().max() <= 4096
        assert got.sequence_id.nunique() <= -(-got.length.sum() // 4096) + (1 if range_rows > 1000 else 6)
    assert packing.pack_documents(docs.limit(0)).collect() == []


def test_token_ids_of_odd_texts():
    import random

    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    tokenizer, own, r = Tokenizer.from_file(path), packing.Encoder(path), random.Random(3)
    assert own.known
    odd = [*"aZ9 .,!'-<|>\n\t\r\x00\x07\x0b\x0c\x1c\x85\xa0", "İ", "ı", "é", "\u0301", "\u0307", "ß", "ŉ", "ǅ", "Σ", "ﬁ", "½", "٣", "漢", "ᄒ", "ᅡ", "\u200d", "😀", "<|endoftext|>", "'s", "\u212a", "ª", "\ufeff", "\ue000"]
    texts = ["Bu İ.", "İ, ve", "café x\x00.", "café \x07-", "x" * 5000, ""]
    texts += ["".join(r.choice(odd) if r.random() < 0.8 else chr(r.randint(32, 0x3000)) for _ in range(r.randint(1, 14))) for _ in range(20_000)]
    want = [np.asarray(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert own.encode_all(texts) == want == own.encode_all(texts)
    assert all(len(c) <= own.LONGEST for c in own.chunks)
    own.known = False  # another vocabulary's rules
    assert own.encode_all(texts[:500]) == want[:500]


def test_sweep_equals_best_fit():
    r = np.random.default_rng(2)
    lengths = sorted(r.integers(1, 41, 500).tolist(), reverse=True)
    given = {-k - 1: int(g) for k, g in enumerate(r.integers(1, 41, 30))}  # gaps that are there already
    rows = sorted([(n, 1, (k, 0, 0, n, 0, k), None) for k, n in enumerate(lengths)] + [(g, 0, None, s) for s, g in given.items()], key=lambda x: (-x[0], x[1]))
    out = list(packing.sweep([(x[0], x[2], x[3]) for x in rows], 0, 40, 0))
    end = {x[9]: x[10] for x in out if x[0] == packing.GAP}
    plain = dict(given)  # one at a time: the closest successor, or a new sequence
    for n in lengths:
        at = min((s for s in plain if plain[s] >= n), key=lambda s: plain[s], default=None)
        if at is None:
            at = len([s for s in plain if s >= 0])
            plain[at] = 40
        plain[at] -= n
    assert sum(x[0] == packing.PLACED for x in out) == 500
    assert Counter(end.values()) == Counter(v for v in plain.values() if v)
    waits = list(packing.sweep([(9, (1,) * 6, None), (8, None, 5), (7, (2,) * 6, None), (6, (3,) * 6, None)], 3, 40, None))
    assert [(x[0], x[2]) for x in waits] == [(packing.PENDING, 0), (packing.PLACED, None), (packing.PENDING, 1), (packing.GAP, -1)]


def test_ranges_settle_like_brackets():
    r = np.random.default_rng(6)
    for _ in range(200):
        pending, spare = ({k: int(n) for k, n in enumerate(r.integers(0, 4, 7)) if n} for _ in range(2))
        got = {(part, k): (at, begin + k - low) for part, low, high, at, begin in packing.settle(pending, spare) for k in range(low, high)}
        want, stack = {}, []
        for part in range(7):  # one at a time, nearest range above first
            for k in range(pending.get(part, 0)):
                if stack:
                    want[part, k] = stack.pop()
            stack += [(part, k) for k in range(spare.get(part, 0))][::-1]
        assert got == want and len(packing.settle(pending, spare)) <= 14


# ---- 4 and 8: native, against SQL


def test_line_dedup_sql(spark, docs):
    duckdb.sql(f"create or replace view documents as from '{DIR}/documents.parquet'")
    got = line_dedup.dedup_lines(docs).select("doc_id", "text", "n_lines", "n_removed")
    assert Counter(map(tuple, got.collect())) == Counter(duckdb.sql(line_dedup.ORACLE).fetchall())


def test_line_dedup_edges(spark, odd):
    rows = [(1, "p\na\n\nb\nc\nd\nq"), (2, "x\na\nb \nc\nd"), (3, "a\nb"), (4, None), (5, "a\nb\nc"), (5, "a\nb\nc")]
    got = line_dedup.dedup_lines(spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, c int")).orderBy("doc_id").collect()
    assert [r.text for r in got] == ["p\na\n\nb\nc\nd\nq", "x", "a\nb", None, "", ""]
    assert line_dedup.dedup_lines(odd).count() == odd.count() and line_dedup.dedup_lines(odd.limit(0)).count() == 0
    clash = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], "doc_id long, text string, _id int, _lines int, n_lines int, _row int")
    out = line_dedup.dedup_lines(clash)
    assert out.columns == ["doc_id", "text", "_id", "_lines", "_row", "n_lines", "n_removed"]
    assert [r.text for r in out.orderBy("doc_id").collect()] == [r.text for r in got]
    # rows of one doc_id lose lines of their own text only
    two = spark.createDataFrame([(1, "a\nb\nc\nd"), (9, "a\nb\nc\nz"), (9, "k\nl\nm\nn"), (None, "x\nk\nl\nm")], "doc_id long, text string")
    assert sorted((r.text, r.n_removed) for r in line_dedup.dedup_lines(two).collect()) == [("a\nb\nc\nd", 0), ("k\nl\nm\nn", 0), ("x", 3), ("z", 3)]


def test_line_dedup_of_common_windows(spark, docs, monkeypatch):
    want = Counter(map(tuple, line_dedup.dedup_lines(docs, 50).select("doc_id", "text", "n_removed").collect()))
    for hot in (1, 3):
        monkeypatch.setattr(common, "LEAST_HOT", hot)
        assert Counter(map(tuple, line_dedup.dedup_lines(docs, 50).select("doc_id", "text", "n_removed").collect())) == want


def test_line_dedup_long_passages(spark, docs):
    import corpus_pipeline

    long, half, short = (" ".join(f"{c}{k}" for k in range(n)) for c, n in (("l", 51), ("h", 30), ("s", 50)))
    rows = [(1, f"p\n{long}\nq\n{short}"), (2, f"x\n {long}\ny\n{short}"), (3, long), (4, f"{half}\n\n{half}!\nz"), (5, f"w\n{half}\n{half}!"), (6, f"{long}\n{long}\nlast"), (7, None), (8, f"{long}\n{half}"), (9, half)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in corpus_pipeline.dedup_lines(spark, df, DIR).collect()}
    assert got == {1: rows[0][1], 2: f"x\ny\n{short}", 4: rows[3][1], 5: "w", 6: "last", 7: None, 8: half, 9: half}
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(df).collect()} == dict(rows)
    seen = Counter(x.strip(" \t\r") for r in corpus_pipeline.dedup_lines(spark, docs, DIR).collect() for x in (r.text or "").split("\n") if len(re.findall(WORD, x)) > 50)
    assert max(seen.values(), default=1) == 1


def test_mixing_sql(spark, docs):
    duckdb.sql(f"create or replace view documents as from '{DIR}/documents.parquet'")
    assert Counter(map(tuple, mixing.mix_sources(docs).collect())) == Counter(duckdb.sql(mixing.ORACLE).fetchall())


def test_mixing_edges(spark, odd):
    clash = odd.selectExpr("*", "1 as target", "2 as few", "'x' as _row", "3 as size")
    assert mixing.mix_sources(clash, keep=True).count() == odd.count()
    got = mixing.mix_sources(odd, keep=True).collect()
    assert len(got) == odd.count() and all(0 <= r.taken <= 3 * r.size for r in got)
    total = sum(r.size for r in got)
    by = {r._row['source']: (r.source_size, r.target) for r in got}
    assert sum(t for _, t in by.values()) == pytest.approx(total)
    assert all(t <= 3 * s + 1e-6 for s, t in by.values())
    assert mixing.mix_sources(odd.limit(0)).collect() == []
    assert all(r.taken == 0 for r in mixing.mix_sources(odd.where("text is null")).collect())


def test_mixing_sql_with_small_and_odd_sources(spark, tmp_path):
    sizes = [("a", 900, 90), ("b", 3, 11), ("c", 6, 40), (None, 30, 7), ("one", 1, 1), ("d", 500, 120), ("none", 4, 0)]
    rows = [(n * 10_000 + k, s, " ".join(["w"] * words)) for n, (s, number, words) in enumerate(sizes) for k in range(number)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/d")
    duckdb.sql(f"create or replace view documents as from '{tmp_path}/d/*.parquet'")
    got = mixing.mix_sources(spark.read.parquet(f"{tmp_path}/d")).collect()
    assert Counter(map(tuple, got)) == Counter(duckdb.sql(mixing.ORACLE).fetchall())
    one = next(r for r in got if r.doc_id == 40_000)
    assert (one.size, one.target, one.taken) == (1, 3.0, 3)


def test_apportionment_ranks_all_that_matters(spark):
    r = np.random.default_rng(12)
    for seats, keys in ((7, 3), (1000, 40), (50, 200), (100_000, 6), (1, 5)):
        votes = [int(v) for v in r.integers(0, 50, keys) ** int(r.integers(1, 4))]
        quotients = sorted((-v / (2 * k + 1), i, k) for i, v in enumerate(votes) if v for k in range(min(seats, 2 + 2 * v * seats // sum(votes))))
        want = Counter(i for _, i, _ in quotients[:seats])
        df = spark.createDataFrame([(i, v, seats) for i, v in enumerate(votes)], "i long, v long, s long")
        got = {x.i: x.won for x in mixing.apportion(df, ["i"], [], "s", "v", ["i"]).collect() if x.won}
        assert got == want and (not want or sum(got.values()) == seats)


def test_mixing_small_sources(spark):
    def mixed(groups, blocks):
        rows = [(n * 1000 + k, s, " ".join(["w"] * words)) for n, (s, number, words) in enumerate(groups) for k in range(number)]
        by = {}
        for r in mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, source string, text string"), blocks=blocks, keep=True).collect():
            size, target, taken, docs = by.get(r._row.source, (0, 0, 0, 0))
            by[r._row.source] = (size + r.size, r.target, taken + r.taken, docs + 1)
            assert 0 <= r.taken <= 3 * r.size
        total = sum(v[0] for v in by.values())
        assert total - 2 * -(-total // blocks) <= sum(v[2] for v in by.values()) <= total
        return by

    # beside a hot source: under half a block, half a block, a few blocks
    by = mixed([("a", 400, 100), ("b", 3, 11), ("c", 6, 40), ("d", 9, 90)], 64)
    assert {s: by[s][2] for s in "bcd"} == {"b": 99, "c": 720, "d": 2430} and by["a"][2] == pytest.approx(by["a"][1], rel=0.02)
    # a large source whose target is a few blocks, over several shards, among many small ones
    by = mixed([("z", 800, 100), *((f"s{n:03}", 3, 200) for n in range(200))], 512)
    assert by["z"][1] < 20 * 392 and all(taken == pytest.approx(target, rel=2e-3) for _, target, taken, _ in by.values())


# ---- 5 and 9


def test_quality(spark, docs, labels, odd):
    got = quality.score_quality(docs, labels).collect()
    truth = {r[0]: r[1] for r in labels.select("doc_id", "quality").collect()}
    assert len(got) == docs.count()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    kept = quality.score_quality(odd.selectExpr("*", "1 as score", "2 as held_out", "3 as c0", "'x' as _row"), labels, keep=True)
    assert kept.select("_row.*").columns == [*odd.columns, "score", "held_out", "c0", "_row"] and kept.count() == odd.count()
    assert quality.score_quality(odd.limit(0), labels).collect() == []
    many = labels.union(labels).union(labels)  # repeated labels and documents stay within the sample
    assert quality.labelled_rows(docs.union(docs), many, 30).count() == 30
    assert {r.score for r in quality.score_quality(odd, labels.limit(0)).collect()} == {0.5}
    m = quality.Machine()
    m.fitted = True
    ids, x = m.inputs(np.array([3, 9, 77]), np.ones(quality.STATS))
    pairs = sum(float(m.v[ids[i]] @ m.v[ids[j]]) * x[i] * x[j] for i in range(len(ids)) for j in range(i))
    assert m.raw(ids, x)[0] == pytest.approx(pairs, rel=1e-9)


@pytest.fixture(scope="module")
def larger(spark):
    return [spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels")]


def test_quality_held_out(larger):
    docs, labels = larger
    got = quality.score_quality(docs, labels).where("held_out").join(labels.select("doc_id", "quality"), "doc_id").collect()
    assert len(got) > 600 and np.mean([r.predicted == r.quality for r in got]) > 0.98


def test_toxicity_held_out(larger):
    docs, labels = larger
    got = toxicity.score_toxicity(docs, labels).where("held_out").join(labels.select("doc_id", "toxic"), "doc_id").collect()
    toxic = [r.predicted for r in got if r.toxic == 1]
    assert len(toxic) > 100 and np.mean(toxic) > 0.85 and np.mean([r.predicted for r in got if r.toxic == 0]) < 0.01


def test_label_model_sees_no_label():
    r = np.random.default_rng(1)
    rows = [np.unique(r.integers(100, 160, 12)) if k % 8 else np.append(r.choice(20, 6, replace=False), 100 + k % 60) for k in range(600)]
    y = np.array([k % 8 == 0 for k in range(300)], int)
    s = toxicity.Scorer().fit(rows[:300], y, rows[300:], np.zeros((300, toxicity.PATTERNS), int))
    assert set(s.terms) <= set(range(20)) and abs(s.model.prior - 1 / 8) < 0.02
    flipped = toxicity.Scorer().fit(rows[:300], y, rows[300:], np.zeros((300, toxicity.PATTERNS), int))
    assert (s.w == flipped.w).all() and s.model.on[2:].min() > 5 * s.model.off[2:].max()


def test_toxicity(spark, docs, labels, odd):
    got = toxicity.score_toxicity(docs, labels).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    assert toxicity.score_toxicity(odd, labels).count() == odd.count()
    assert toxicity.score_toxicity(odd.limit(0), labels).collect() == []
    assert all(r.score < 1e-6 for r in toxicity.score_toxicity(odd, labels.limit(0)).collect())


def test_shared_beginnings():
    table = common.WordTable(toxicity.terms_of)
    found = lambda text: toxicity.terms_in(map(table.__getitem__, set(text.split())))
    beginning = toxicity._hash("abcd*")
    shared = beginning ^ toxicity._SHARED
    assert found("abcdx") == set(toxicity.terms_of("abcdx")) and found("") == set()
    assert beginning in found("abcdx abcdx abc") and shared not in found("abcdx abcdx abc")  # one word, twice
    assert shared in found("abcdx abcdy") and toxicity._hash("abcdx") ^ toxicity._SHARED not in found("abcdx abcdy")


def test_label_model_finds_accuracies():
    r = np.random.default_rng(0)
    y = r.random(4000) < 0.2
    votes = np.stack([np.where(r.random(4000) < a, y, r.random(4000) < 0.05) for a in (0.9, 0.6, 0.8, 0.7)], 1).astype(float)
    votes = np.concatenate([votes, votes[:, :1]], 1)  # a copy must not count twice
    m = toxicity.LabelModel().fit(votes, np.clip(votes.mean(1), 0.05, 0.95))
    assert abs(m.prior - 0.2) < 0.05 and m.weight[0] == m.weight[4] == 0.5 and np.mean((m.posterior(votes) > 0.5) == y) > 0.93


# ---- 6


def test_base_spans():
    text = "mail a.b+c@x-y.co.uk, 1.2.3.4 300.1.1.1, 4111 1111 1111 1111, +1 (555) 123-4567. @no a@b 99"
    got = [(pii.KINDS[k], text[s:e]) for k, s, e in pii.base_spans(text)]
    assert got == [("email", "a.b+c@x-y.co.uk"), ("ip", "1.2.3.4"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (555) 123-4567")]
    plain = {0: r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", 1: r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", 2: r"[0-9]([\x20-]?[0-9])+", 3: r"\+[0-9][\x20().0-9-]+[0-9]"}
    r = np.random.default_rng(5)
    for _ in range(3000):
        t = "".join(r.choice(list("a1.2@+-( 9b0"), int(r.integers(0, 40))))
        want = []
        for kind, p in plain.items():
            for m in re.finditer(p, t):
                d = re.sub("[^0-9]", "", m[0])
                ok = {0: True, 1: all(int(x) <= 255 for x in m[0].split(".")) if kind == 1 else 0, 2: 12 <= len(d) <= 19 and pii.luhn(d), 3: 9 <= len(d) <= 15}[kind]
                if ok:
                    want.append((kind, *m.span()))
        assert pii.base_spans(t) == sorted(want, key=lambda s: (s[1], s[0])), t


def test_tagger_gradient_and_reconciling():
    x, y = pii.training_windows(["some text with 4111 numbers and words " * 20], made=8)
    t = pii.Tagger(hidden=3, embed=3)
    t.p = {k: v.astype(float) for k, v in t.p.items()}
    x, y = x[:4, :10], y[:4, :10]
    _, g = t.gradient(x, y)
    for k in ("O", "T", "Wf", "Ub", "Bf"):
        at = tuple(0 for _ in g[k].shape)
        t.p[k][at] += 1e-3
        up = t.gradient(x, y)[0]
        t.p[k][at] -= 2e-3
        down = t.gradient(x, y)[0]
        t.p[k][at] += 1e-3
        assert g[k][at] == pytest.approx((up - down) / 2e-3, rel=1e-2, abs=1e-5)


def test_windows_are_reconciled_over_the_whole_text():
    r = np.random.default_rng(8)
    for length in (1, 40, 256, 257, 448, 449, 1000):
        text = "".join(r.choice(list("ab 1@é"), length))
        cut = pii.windows(text)
        every = np.concatenate([pii.codes(text), np.zeros(pii.WINDOW, int)])
        assert len(cut) * pii.STRIDE + pii.WINDOW - pii.STRIDE >= length
        assert all((w == every[k * pii.STRIDE : k * pii.STRIDE + pii.WINDOW]).all() for k, w in enumerate(cut))
        ends = np.unique(r.integers(0, length + 1, 8)).tolist()
        spans = [(int(r.integers(0, 5)), a, b) for a, b in zip(ends[::2], ends[1::2], strict=False)]
        tags = np.concatenate([pii.tags_of(length, spans), np.zeros(pii.WINDOW, int)])
        found = {k: tags[k * pii.STRIDE : k * pii.STRIDE + pii.WINDOW] for k in range(len(cut))}
        assert pii.reconciled(length, found) == spans
        assert pii.reconciled(length, {k: t for k, t in found.items() if t.any()}) == spans


def test_decoding_finds_the_best_path():
    from itertools import product

    r, t = np.random.default_rng(9), pii.Tagger(hidden=3, embed=3)
    t.p |= {"T": r.normal(0, 1, (pii.TAGS, pii.TAGS)).astype(np.float32), "s": r.normal(0, 1, pii.TAGS).astype(np.float32)}
    x = r.integers(0, pii.ALPHABET, (6, 4)).astype(np.uint8)
    emit = t.scores(x.astype(int))[0]
    assert np.allclose(t.emissions(x), emit.transpose(0, 2, 1), atol=1e-5)
    for n, got in enumerate(t.decode(x, prove=False)):
        value = lambda path: t.p["s"][path[0]] + sum(emit[k, n, g] for k, g in enumerate(path)) + sum(t.p["T"][a, b] for a, b in zip(path, path[1:], strict=False))  # noqa: E731, B023
        assert value(tuple(got)) == pytest.approx(max(map(value, product(range(pii.TAGS), repeat=4))), abs=1e-4)
    seen = 0
    for _ in range(60):  # what is proven to be outside is so
        t.p |= {"T": r.normal(0, 0.5, (pii.TAGS, pii.TAGS)).astype(np.float32), "c": np.append(r.uniform(0, 4), np.zeros(pii.TAGS - 1)).astype(np.float32)}
        x = r.integers(0, pii.ALPHABET, (40, 12)).astype(np.uint8)
        assert (t.decode(x) == t.decode(x, prove=False)).all()
        seen += int((~t.undecided(t.emissions(x))).sum())
    assert seen > 100


def test_undecided_windows_of_all_blocks_are_decoded_together(monkeypatch):
    r, t = np.random.default_rng(3), pii.Tagger()
    t.p["c"] = np.append(np.float32(0.8), np.zeros(pii.TAGS - 1, np.float32))
    x = r.integers(0, pii.ALPHABET, (300, pii.SOME + 4)).astype(np.uint8)
    want = {j: tags for j, tags in enumerate(t.decode(x, prove=False)) if tags.any()}
    viterbi, calls = t.viterbi, []
    monkeypatch.setattr(t, "viterbi", lambda emit: calls.append(emit.shape[2]) or viterbi(emit))
    for most, few in ((pii.BLOCK, 1), (50, 5)):  # once for 15 blocks; as often as the bound asks for
        monkeypatch.setattr(pii, "BLOCK", most)
        calls.clear()
        got = dict(t.inside((x[k : k + 20], list(range(k, k + 20))) for k in range(0, 300, 20)))
        assert got.keys() == want.keys() and all((got[k] == want[k]).all() for k in want)
        assert 1 <= len(calls) <= few and sum(calls) < 300
    assert 40 < len(want) < 300 and list(t.inside([])) == []


def test_gates_far_from_zero():
    r, t = np.random.default_rng(4), pii.Tagger()
    for k in ("Wf", "Wb", "Bf"):
        t.p[k] = t.p[k] * np.float32(1000)
    x = r.integers(0, pii.ALPHABET, (50, 30)).astype(np.uint8)
    with np.errstate(invalid="raise", divide="raise"):
        assert np.allclose(t.emissions(x), t.scores(x.astype(int))[0].transpose(0, 2, 1), atol=1e-3)


def test_texts_without_digits_are_not_searched_for_numbers():
    from time import process_time

    def least(f):
        took = []
        for _ in range(5):
            began = process_time()
            f()
            took.append(process_time() - began)
        return min(took)

    text = "plain words a@b.co and no numbers at all, é \n" * 20_000
    assert pii.base_spans(text[:46]) == [(0, 12, 18)]
    plain = text.replace("@", " ")
    assert least(lambda: pii.base_spans(plain)) < least(lambda: [list(p.finditer(plain)) for p in (pii._IP, pii._CARD)]) / 3


def test_training_ids_are_those_of_least_hash(spark):
    from pyspark.sql import functions as F

    for rare, rows in ((3, 4000), (900, 4000), (5, 50)):  # met among the first, or by a search of all texts; few rows
        texts = spark.range(rows).selectExpr("if(id = 9, null, id % 3000) as doc_id", f"case when id % {rare} = 1 then 'a 1' when id % 7 = 0 then null else 'b' end as text")
        for sample in (2, 30):
            ids = texts.where("doc_id is not null").select("doc_id", F.coalesce(F.col("text").rlike("[0-9@]"), F.lit(False)).alias("able"), F.xxhash64("doc_id").alias("h"))
            want = {r["doc_id"] for able in (True, False) for r in ids.where(F.col("able") == able).orderBy("h", "doc_id").limit(sample).collect()}
            assert set(pii.chosen_ids(texts, sample)) == want
    assert pii.chosen_ids(texts.limit(0), 3) == []


def test_numbers_of_any_length():
    assert pii.base_spans("x 1.2.3." + "0" * 5000) == [(1, 2, 5008)]
    assert pii.base_spans("9" * 6000 + "." + "1.1.1") == [] and pii.base_spans("1.2.3.0255 1.2.3.256") == [(1, 0, 10)]


def test_added_spans_take_whole_words():
    text = 'my token = "0a1b2c3d4e5f" and 4111 or a@b.co.x1y2z3a4b5c6d7 \n '
    base = pii.base_spans(text)
    at = text.index("token")
    cut = lambda found: [text[s:e] for _, s, e in pii.added(text, base, found)]
    assert cut([(4, at + 2, at + 18)]) == ['token = "0a1b2c3d4e5f']
    assert cut([(4, at + 2, at + 15), (4, at + 16, at + 20)]) == ['token = "0a1b2c3d4e5f']
    assert cut([(4, base[0][1] + 2, base[0][2])]) == [] and cut([(2, len(text) - 2, len(text))]) == [] and cut([]) == []
    assert pii.added("", [], []) == []


def test_personal_data(spark, odd, docs):
    tagger = pii.Tagger()
    got = pii.find_personal_data(odd, tagger).collect()
    assert len(got) == odd.count()
    assert {r.base_sha256 for r in got} == {hashlib.sha256(b"").hexdigest()}
    texts = dict(docs.select("doc_id", "text").collect())
    secret, met, caught = re.compile(r"password=(\w+)|token = \"(\w+)\"|(AKIA[A-Z0-9]{16})"), 0, 0
    for r in pii.find_personal_data(docs).collect():
        spans = [(int(a), int(b)) for a, b in (x.split(":")[1:] for x in r.spans.split(",") if x)]
        for m in secret.finditer(texts[r.doc_id] or ""):
            at = next(m.span(g) for g in (1, 2, 3) if m[g])
            met, caught = met + 1, caught + any(a <= at[0] and b >= at[1] for a, b in spans)
        base = pii.base_spans(texts[r.doc_id])
        said = [f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in base]
        assert r.base_sha256 == hashlib.sha256(",".join(said).encode()).hexdigest() and set(said) <= set(r.spans.split(","))
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == j for k, _, _ in base) for j in range(4))
    assert caught >= 0.8 * met
    words = "password: correcthorsebatterystaple ok"
    assert [words[a:b] for _, a, b in pii.added(words, [], [(4, 0, 35)])] == ["password: correcthorsebatterystaple"]
    clash = odd.selectExpr("*", "1 as spans", "2 as n_email", "'x' as snippet")
    assert pii.find_personal_data(clash, tagger).count() == odd.count() and pii.find_personal_data(odd.limit(0)).collect() == []


# ---- 7


def near(rows, width):
    sets = {}
    for i, t in rows:
        words = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(words)} if 0 < len(words) < width else {tuple(words[k : k + width]) for k in range(len(words) - width + 1)}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_near_duplicates(spark, docs, odd):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    r = np.random.default_rng(7)
    base = [f"v{k}" for k in range(120)]
    for n in range(60):  # a group whose members resemble one another more or less
        words = list(base)
        for k in r.integers(0, 120, int(r.integers(0, 7))):
            words[k] = f"u{n}-{k}"
        rows.append((10_000 + n, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {q[0]: (q[1], q[2]) for q in minhash.near_duplicates(df, width=4).collect()}
    assert got == near(rows, 4)
    out = minhash.near_duplicates(odd).collect()
    assert len(out) == odd.count() and {q.component_id for q in out if q.doc_id in (5, 6)} == {5}
    assert minhash.near_duplicates(odd.limit(0)).collect() == []


def test_near_duplicates_of_hot_buckets_and_shared_ids(spark, docs, monkeypatch):
    want = Counter(map(tuple, minhash.near_duplicates(docs, width=4).collect()))
    monkeypatch.setattr(common, "LEAST_HOT", 2)
    assert Counter(map(tuple, minhash.near_duplicates(docs, width=4).collect())) == want
    texts = [f"{a} b c d e f {k}" for k, a in enumerate("pqrs")] + ["p b c d e f 0"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    real, seeds = minhash._signed, []

    def poor(width, bands, rows, seed):  # with the first seed all sets share an id
        def run(batches):
            for batch in real(width, bands, rows, seed)(batches):
                yield batch.set_column(2, "sid", pa.array([5] * batch.num_rows, pa.int64())) if seed == 0 else batch

        seeds.append(seed)
        return run

    monkeypatch.setattr(minhash, "_signed", poor)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df).collect()}
    assert seeds == [0, 1] and got == {0: 0, 1: 1, 2: 2, 3: 3, 4: 0}


def test_bayes_bounds_keep_true_pairs():
    least = minhash.least_matches(0.8, 192, 24, 1e-6)
    r = np.random.default_rng(3)
    hits = np.cumsum(r.random((20_000, 192)) < 0.8, axis=1)[:, 23::24]
    assert (hits >= np.array(least)).all(axis=1).mean() > 0.999 and least[-1] > 0.55 * 192


# ---- 10


def test_fingerprints(spark, docs, odd):
    rows = sorted(map(tuple, docs.select("doc_id", "text").collect()))
    got = {r.doc_id: r for r in fingerprint.fingerprint_documents(docs).collect()}
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        e, r = fingerprint.edited(t, after), got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert r.fingerprint == fingerprint.digest(fingerprint.canonical(t)).hex()
        assert r.near_next == (fingerprint.canonical(t) == fingerprint.canonical(after)) and r.near_edited == (fingerprint.canonical(t) == fingerprint.canonical(e))
    for parts in (1, 4):
        out = fingerprint.fingerprint_documents(odd, parts).collect()
        assert len(out) == odd.count() and len({r.fingerprint for r in out if r.doc_id == 1}) == 1
    assert fingerprint.fingerprint_documents(odd.limit(0)).collect() == []


def test_colliding_digests_are_told_apart(spark, docs):
    texts = [t or "" for _, t in docs.select("doc_id", "text").collect()]
    forms = {fingerprint.canonical(t) for t in texts}
    assert fingerprint.colliding(docs) == set()
    met = Counter(fingerprint.digest(c, 1) for c in forms)  # digests of one byte collide
    want = {d for d, n in met.items() if n > 1}
    assert want and fingerprint.colliding(docs, 1) == want
    got = {r.doc_id: r.fingerprint for r in fingerprint.fingerprint_documents(docs, width=1).collect()}
    named: dict[str, set[str]] = {}
    for i, t in docs.select("doc_id", "text").collect():
        named.setdefault(got[i], set()).add(fingerprint.canonical(t or ""))
    assert all(len(c) == 1 for c in named.values()) and len(named) == len(forms)


# ---- pipeline


def test_pipeline(spark, docs, odd, tmp_path):
    import corpus_pipeline

    frame, stay = docs, None
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frame, DIR).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        if name != "pack":
            assert out.columns == docs.columns
        if name == "near_dedup":
            want = near([tuple(r) for r in frame.select("doc_id", "text").collect()], 5)
            assert {r[0] for r in out.select("doc_id").collect()} == {i for i, (_, c) in want.items() if c == i}
        stay, frame = frame, out
        if name == "quality":
            model = {r.doc_id: r.predicted for r in quality.score_quality(docs, spark.read.parquet(f"{DIR}/labels.parquet")).collect()}
            assert {r.doc_id for r in out.collect()} == {i for i, p in model.items() if p}
        if name == "mix":
            taken = {r.doc_id: r.taken for r in mixing.mix_sources(stay).collect() if r.taken}
            made = Counter()
            for i, t in out.select("doc_id", "text").collect():
                made[i] += len(re.findall(WORD, t))
            assert made == taken
    packed = {r[0] for r in frame.select("doc_id").distinct().collect()}
    assert packed == {r[0] for r in stay.select("doc_id").distinct().collect()}


def test_stages_on_odd_rows(spark, odd):
    import corpus_pipeline

    clash = odd.selectExpr("*", "1 as _row", "2 as score", "3 as n_removed", "4 as number", "5 as hash", "6 as copy", "7 as _n", "cast(length(text) as int) as n_chars")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, clash.limit(0), DIR).collect() == []
        out = stage(spark, clash, DIR)
        if name == "pack":
            assert out.select("doc_id").distinct().count() == 8
        else:
            assert out.columns == clash.columns and out.schema["n_chars"].dataType == clash.schema["n_chars"].dataType
            rows = out.collect()
            assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)
            kept = {"line_dedup": 10, "near_dedup": 8}.get(name)
            assert kept is None or len(rows) == kept


def test_near_dedup_of_repeated_ids(spark):
    import corpus_pipeline

    a, b, c, d, e = (" ".join(f"{x}{k}" for k in range(40)) for x in "abcde")
    rows = [(7, a, "x"), (7, b, "x"), (8, a, "x"), (3, c, "x"), (9, c + " z", "x"), (9, d, "x"), (9, d, "y"), (4, e, "x"), (4, e + " z", "x"), (None, e, "x"), (5, None, "x"), (5, a + " z", "x")]
    for n in (1, 6):
        df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(n)
        got = corpus_pipeline.dedup_documents(spark, df, DIR).collect()
        ids = Counter((r.doc_id, r.text) for r in got)
        one = (4, e) if (4, e) in ids else (4, e + " z")
        assert ids == Counter([(5, None), (5, a + " z"), (7, b), (3, c), (9, d), one, (None, e)])
        assert n == 1 or seen == Counter(map(tuple, got))
        seen = Counter(map(tuple, got))
