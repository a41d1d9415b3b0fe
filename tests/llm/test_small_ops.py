"""Fingerprints, token files, top-k search, page text, packing and mixing against plain versions."""

import hashlib
import itertools
import math
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandsift.llm import html_blocks, impact_search, mixing, packing, token_files, weighted_minhash
from strandsift.llm.common import texts
from conftest_words import words


def test_fingerprints_follow_the_order_of_ids(spark, make_docs, rng):
    texts = [words(rng, rng.randint(0, 60)) for _ in range(80)] + ["", "one", None]
    docs = make_docs(texts)
    texts[-1] = ""
    got = {r.doc_id: r for r in weighted_minhash.fingerprints(docs.repartition(5), buckets=7).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        u = texts[(k + 1) % len(texts)]
        q = len(t) // 4
        new = t[: len(t) - q] + u[:q]
        r = got[k]
        assert r.n_chars == len(t)
        assert r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        codes = weighted_minhash.Sampler().codes([t, new, u])
        assert r.fingerprint == weighted_minhash.text_of(codes[0])
        assert r.near_edited == pytest.approx((codes[0] == codes[1]).mean())
        assert r.near_next == pytest.approx((codes[0] == codes[2]).mean())


def test_likeness_is_generalised_jaccard(rng):
    s = weighted_minhash.Sampler(2048)
    a, b = words(rng, 300, 200), words(rng, 300, 200)
    weigh = lambda t: {w: t.split().count(w) * min(len(w), 12) ** 2 for w in set(t.split())}
    x, y = weigh(a), weigh(b)
    true = sum(min(x.get(w, 0), y.get(w, 0)) for w in {*x, *y}) / sum(max(x.get(w, 0), y.get(w, 0)) for w in {*x, *y})
    c = s.codes([a, b])
    assert abs((c[0] == c[1]).mean() - true) < 4 * math.sqrt(true * (1 - true) / 2048) + 0.005


def test_likeness_at_the_samples_in_use():
    """The root mean square error of 600 pairs is that of 128 samples; 64 would give 0.06 at a likeness of 0.5."""
    s = weighted_minhash.Sampler()
    errors = []
    for k in range(600):
        both, own, other = ([f"w{k:05}{side}{i:02}" for i in range(n)] for side, n in (("s", 24), ("a", 12), ("b", 12)))
        c = s.codes([" ".join(both + own), " ".join(both + other)])
        errors.append(weighted_minhash.likeness(c[0], c[1]) - 0.5)
    assert s.samples == 128
    assert math.sqrt(np.mean(np.square(errors))) < 0.051
    assert abs(np.mean(errors)) < 0.01


def test_fingerprints_of_odd_rows(spark, odd_docs):
    rows = weighted_minhash.fingerprints(odd_docs).collect()
    assert sorted(r.doc_id for r in rows) == [1, 2, 3, 4, 4, 7]
    assert weighted_minhash.fingerprints(odd_docs.limit(0)).count() == 0
    one = weighted_minhash.fingerprints(odd_docs.where("doc_id = 7")).collect()
    assert len(one) == 1 and one[0].near_next == 1


def test_codes_round_trip():
    r = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        ranks = r.choice([0, 5, 255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1], n).astype(np.uint32)
        c, d = token_files.packed(ranks)
        assert len(c) == -(-n // 4)
        assert (token_files.unpacked(np.frombuffer(c, np.uint8), np.frombuffer(d, np.uint8), n) == ranks).all()


def test_token_files_read_back(spark, make_docs, rng, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(token_files.vocabulary_path())
    texts = [words(rng, rng.randint(0, 50)) for _ in range(40)] + ["It's the end, isn't it?! <|endoftext|>, x", "ÉCOLE d'été... 日本語。", "", None, "a,.b c..\tİstanbul\x1cz"]
    files, folder = token_files.export(make_docs(texts).repartition(3), str(tmp_path / "t"))
    got = sorted(token_files.read_back(files, folder).collect())
    start = 0
    for k, (r, t) in enumerate(zip(got, texts)):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (k, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len(got) == len(texts)


def test_token_files_of_odd_rows(spark, odd_docs, tmp_path):
    files, folder = token_files.export(odd_docs, str(tmp_path / "t"))
    assert sorted(r.doc_id for r in token_files.read_back(files, folder).collect()) == [1, 2, 3, 4, 4, 7]
    files, folder = token_files.export(odd_docs.limit(0), str(tmp_path / "e"))
    assert token_files.read_back(files, folder).count() == 0


def test_lengths_and_forgotten_chunks(spark, make_docs, odd_docs, rng, monkeypatch):
    from tokenizers import Tokenizer

    path = token_files.vocabulary_path()
    tok, docs = Tokenizer.from_file(path), [words(rng, rng.randint(0, 40)) + f" n{k}.x " for k in range(200)] + ["", " \n", "<|x|> 日本 isn't 😀"]
    monkeypatch.setattr(token_files, "_HELD", 60)  # chunks are forgotten again and again
    enc, largest = token_files.Encoder(path), 0
    for e in range(0, len(docs), 5):
        some = pa.array(docs[e : e + 5])
        want = [tok.encode(t, add_special_tokens=False).ids for t in docs[e : e + 5]]
        assert [x.tolist() for x in enc.encode(some)] == want
        assert enc.lengths(some).tolist() == [len(x) for x in want]
        largest = max(largest, len(enc.index))
    assert largest < 60 + 5 * 50
    for table in (make_docs(docs), odd_docs, odd_docs.limit(0)):
        rows = texts(table).repartition(3)
        ids = token_files.tokens(rows, path).collect()
        assert sorted(map(tuple, token_files.lengths(rows, path).collect())) == sorted((r.doc_id, len(r.ids) // (4 if r.wide else 2)) for r in ids)


def test_workers_give_memory_back():
    """What a worker holds after some tasks stays small, though each brings 200,000 new words."""
    code = """if True:
        import re
        from pathlib import Path
        import pyarrow as pa
        from strandsift.llm import token_files

        class Frame:
            def mapInArrow(self, run, schema):
                self.run = run

        def held():
            return sum(map(int, re.findall(r"Pss_(?:Anon|Shmem):\\s+(\\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024

        docs, path = Frame(), token_files.vocabulary_path()
        token_files.tokens(docs, path)
        token_files._encoder(path)
        start, n = held(), 0
        for task in range(4):
            text = pa.array([" ".join(f"w{n}" for n in range(k, k + 200)) for k in range(task * 200_000, (task + 1) * 200_000, 200)])
            n += sum(b.num_rows for b in docs.run(iter([pa.RecordBatch.from_arrays([pa.array(range(1000)), text], names=["doc_id", "text"])])))
        print(n, held() - start)
    """
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2]).stdout.split()
    assert int(out[0]) == 4000 and float(out[1]) < 130


@pytest.mark.parametrize("part,queries", [(1000, 1000), (37, 5)])
def test_search_is_exact(spark, part, queries):
    r = np.random.default_rng(2)
    x = r.normal(size=(300, 8)).astype(np.float32)
    x[50:90] = x[50]  # ties
    rows = [(i, [float(v) for v in x[i]]) for i in range(300)] + [(300, None), (301, [float("nan")] * 8), (302, [None] * 8), (None, [1.0] * 8), (5, [float(v) for v in x[5]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = impact_search.search(df, lambda c: c % 10 == 0, 10, part=part, queries=queries).collect()
    ints = np.floor(1024 * x.astype(np.float64)).astype(np.int64)
    for q in range(0, 300, 10):
        want = sorted((-int(ints[q] @ ints[i]), i) for i in range(300) if i != q)[:10]
        assert [(r.rank, r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == [(k, i, -s) for k, (s, i) in enumerate(want, 1)]
    assert impact_search.search(df.limit(0), lambda c: c % 10 == 0).count() == 0
    assert impact_search.search(df.where("vec_id in (0, 1)"), lambda c: c % 10 == 0).count() == 1


def test_search_of_repeated_ids_and_odd_vectors(spark):
    """Ids with different vectors, ragged and empty vectors, large components, a clashing column: against all pairs."""
    r = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in r.integers(-9, 9, n)]) for i, n in zip(r.integers(0, 30, 80), r.integers(0, 6, 80))]
    rows += [(5, [3.0, 4.0]), (5, [4.0, 3.0]), (7, [2.0**17, 1.0]), (10, [2.0**18, -3.0])]
    df = spark.createDataFrame([(*x, 1.0) for x in rows], "vec_id long, embedding array<double>, score double")
    own = sorted({(i, tuple(int(1024 * x) for x in v)) for i, v in rows})
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    want = []
    for q, v in own:
        if q % 5 == 0:
            want += [(q, k, i, -s) for k, (s, i) in enumerate(sorted((-dot(v, u), i) for i, u in own if (i, u) != (q, v))[:4], 1)]
    got = impact_search.search(df, lambda c: c % 5 == 0, 4, part=40, queries=7).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_scores_beyond_the_range_raise():
    index = impact_search.Index(np.arange(2), np.array([[1 << 40], [1 << 40]]))
    with pytest.raises(OverflowError):
        index.top(np.array([1 << 40]), 0, 1)


def test_search_stops_early_where_it_can():
    r = np.random.default_rng(3)
    x = np.floor(r.normal(size=(5000, 16)) * 300).astype(np.int64)
    index = impact_search.Index(np.arange(5000), x)
    for q in range(20):
        ids, scores = index.top(x[q], q, 5)
        want = sorted((-int(x[q] @ x[i]), i) for i in range(5000) if i != q)[:5]
        assert list(zip((-scores).tolist(), ids.tolist())) == want


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="cookie-notice"><p>We use cookies</p></div>
<div id="sidebar"><p>Other things to read today and tomorrow</p></div>
%s
<div class="comments"><p>First! What a great text this is, thank you so much for it.</p></div>
<form><label>Mail</label><input name="m"><button>Send</button></form><footer>&copy; us</footer></body></html>"""


def test_page_with_article():
    body = "<article><h1>The &amp; title</h1><p>One\n  line <b>bold</b><br>more</p><!-- no --><div class='ad'>Buy</div><p>Be.</p><ul><li>a &lt; b</li></ul></article>"
    assert html_blocks.main_text(PAGE % body) == "The & title\n\nOne line bold more\n\nBe.\n\na < b"


def test_page_without_article():
    long = "A sentence of the text that goes on for some time, so that its length shows. " * 2
    text = html_blocks.main_text(PAGE % f"<div><p>{long}</p><p>{long}</p></div>")
    assert text == f"{long.strip()}\n\n{long.strip()}"


@pytest.mark.parametrize(
    "odd",
    ["<svg-icon></svg-icon>", "<video-js></video-js>", "<svg viewBox='0 0 1 1'/>", "<svg/>", "<button>", "<select>", "<audio-player src=x></audio-player>", "<object data=x>"],
)
def test_odd_elements_do_not_cut_the_page(odd):
    assert html_blocks.main_text(f"<article><p>one</p>{odd}<p>two</p></article>") == "one\n\ntwo"
    assert html_blocks.main_text(f"<body>{odd}<article><p>one</p></article>") == "one"


def test_text_of_formulas_stays_and_skipped_elements_go():
    assert html_blocks.main_text("<article><p>let <math><mi>x</mi></math> be</p></article>") == "let x be"
    for name in ("script", "svg", "button", "select", "object", "video"):
        assert html_blocks.main_text(f"<article><p>one</p><{name} a='b'>no</{name}><p>two</p></article>") == "one\n\ntwo"
    assert html_blocks.main_text("<button>a<article><p>one</p></article><button>b</button>") == "one"
    assert html_blocks.main_text("<article><p>one</p><script>var a = '<p>no</p>'") == "one"


def test_odd_pages(spark):
    odd = {None: "", "": "", "<": "<", "<p": "", "<!-- x": "", "<script>a": "", "<article>": "", "<p>a<p class='x>y</p>": "ay", "</div></nav>": "", "plain": "plain", "a < b": "a < b"}
    assert {page: html_blocks.main_text(page) for page in odd} == odd
    long = "<p>" + "word " * 300_000 + "</p><p>end</p>"
    assert html_blocks.main_text(long) == ("word " * 300_000).strip() + "\n\nend"
    rows = [(1, "u", None), (None, None, "<p>x</p>"), (2, "u", ""), (2, "u", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = html_blocks.extract_pages(df).collect()
    assert len(got) == 4 and {r.text for r in got} == {"", "x"}
    assert html_blocks.extract_pages(df.limit(0)).count() == 0


def plain_windows(weights, threshold):
    """Which of the weights lie between a surge, or the run of weights before it, and the three zeros or the end after it."""
    n = len(weights)
    total = lambda i: sum(weights[j] for j in range(i, min(n, i + 3)))
    kept = [False] * n
    for i in range(n):
        if weights[i] and total(i) > threshold:
            stop = next((j for j in range(i, n) if total(j) == 0), n)
            start = next((j + 1 for j in range(i, -1, -1) if weights[j] == 0), 0)
            for j in range(start, stop):
                kept[j] = True
    return [i for i in range(n) if kept[i]]


def test_windows_against_a_plain_version(rng):
    for _ in range(400):
        weights = [float(rng.choice([0, 0, 0, 5, 20, 60, 200])) for _ in range(rng.randint(0, 25))]
        assert html_blocks.between(weights, 90) == plain_windows(weights, 90)


def test_class_words_take_weight_but_do_not_drop_text():
    long = "A sentence of the text that goes on for some time, so that its length shows. " * 5
    assert html_blocks.main_text('<article class="post share"><p>one</p></article>') == "one"
    assert html_blocks.main_text('<article><p>one</p><section class="recommended-reading-notes"><p>two</p></section></article>') == "one\n\ntwo"
    assert html_blocks.main_text('<article><p>one</p><div class="share-buttons"><p>two</p></div><p>three</p></article>') == "one\n\nthree"
    assert html_blocks.main_text(f'<p>Skip</p><div class="widget"><p>{long}</p><p>{long}</p><p>{long}</p></div>').endswith(f"{long.strip()}\n\n{long.strip()}")
    assert html_blocks.main_text(f"<form action=x><p>{long}</p><p>end</p></form>") == f"{long.strip()}\n\nend"
    assert html_blocks.main_text(f'<article><p>one</p></article><section class="comments"><article class="comment"><p>{long}</p></article></section>') == "one"


def test_lines_that_lead_up_to_a_surge_stay_and_menus_part_texts():
    long = "A sentence of the text that goes on for some time, so that its length shows. " * 2
    menu = "".join(f'<p><a href="/{k}">A link of the menu, number {k}</a></p>' for k in range(4))
    page = f"<p>Imprint</p>{menu}<h1>Title</h1><p>By someone</p><p>{long}</p><p>Be.</p><p><a href=x>a source</a></p><p>End.</p>{menu}<p>Contact</p>"
    assert html_blocks.main_text(page).split("\n\n") == ["Title", "By someone", long.strip(), "Be.", "a source", "End."]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_pages_of_the_tables_without_their_markers(sf):
    """The same text whether article and main elements are marked or not; windows drop lines of most pages."""
    import re

    import pyarrow.parquet as pq

    dropped = 0
    pages = [x for x in pq.read_table(f"/root/testdata/{sf}/pages.parquet")["html"].to_pylist() if x]
    for page in pages:
        text = html_blocks.main_text(page)
        assert text
        assert html_blocks.main_text(re.sub(r"<(/?)(article|main)\b", r"<\1div", page)) == text
        lines = html_blocks.lines_of(page)
        dropped += len(html_blocks.kept_lines(lines)) < len(lines)
    assert dropped > 0.5 * len(pages)


@pytest.mark.parametrize("n,buckets", [(1, 3), (6, 1), (7, 3), (8, 4), (5, 9)])
def test_boundaries_are_optimal(rng, n, buckets):
    lengths = np.array(sorted(rng.sample(range(60), n)))
    counts = np.array([rng.randint(1, 9) for _ in range(n)])

    def padding(ends):
        return sum(int(c) * (min(e for e in ends if e >= x) - int(x)) for x, c in zip(lengths, counts))

    best = min(padding([*some, lengths[-1]]) for k in range(min(buckets, n)) for some in itertools.combinations(lengths[:-1], k))
    got = packing.boundaries(lengths, counts, buckets)
    assert len(got) <= buckets and got[-1] == lengths[-1] and padding(got) == best


def test_packing(spark, make_docs, rng, odd_docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(token_files.vocabulary_path())
    docs = make_docs([words(rng, rng.randint(0, 90)) for _ in range(300)] + [None, " \n x\ty\r\nz  ", "日本語 isn't 😀"])
    rows = packing.pack(docs, buckets=4, budget=256).collect()
    assert sorted(r.doc_id for r in rows) == list(range(303))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert all(r.n_tokens == len(tok.encode(texts[r.doc_id], add_special_tokens=False).ids) + 1 <= r.boundary for r in rows)
    seen = {}
    for r in rows:
        seen.setdefault((r.bucket, r.batch), []).append(r.slot)
    for (bucket, batch), slots in seen.items():
        end = next(r.boundary for r in rows if r.bucket == bucket)
        per = max(1, 256 // max(1, end))
        assert sorted(slots) == list(range(len(slots))) and len(slots) <= per
        assert len(slots) == per or batch == max(b for k, b in seen if k == bucket)
    own = {r.doc_id: r.n_tokens for r in packing.pack(docs, length_col="n_chars").collect()}
    assert own == {k: len(t) for k, t in texts.items()}
    assert len(packing.pack(odd_docs).collect()) == 6
    assert len(packing.pack(odd_docs, length_col="n_chars").collect()) == 6
    assert packing.pack(odd_docs.limit(0)).count() == 0


def test_mixing_follows_its_draws(spark, make_docs, rng, odd_docs):
    docs = make_docs([words(rng, rng.randint(1, 30)) for _ in range(900)])
    weights = spark.createDataFrame([("s0", 4.0), ("s1", 1.0)], "source string, weight double")
    rates = {r.source: r.rate for r in mixing.rates(docs, weights=weights).collect()}
    chars = {r.source: r.c for r in docs.groupBy("source").agg(F.sum("n_chars").alias("c")).collect()}
    assert rates["s2"] == 0 and rates["s0"] == pytest.approx(0.8 * sum(chars.values()) / chars["s0"])
    got = {}
    for r in mixing.replicate(docs, weights=weights).collect():
        got.setdefault(r.doc_id, []).append(r.copy)
    for k in range(900):
        u = int(hashlib.md5(f"{mixing.SEED}|{k}".encode()).hexdigest()[:13], 16) / 2**52
        rate = rates[f"s{k % 3}"]
        n, p, total = 0, math.exp(-rate), math.exp(-rate)
        while rate and total <= u:
            n += 1
            p *= rate / n
            total += p
        assert sorted(got.get(k, [])) == list(range(1, n + 1))
    empty = docs.withColumn("text", F.when(F.col("source") != "s2", F.col("text")))
    once = [r.copy for r in mixing.replicate(empty).where("source = 's2'").collect()]
    assert once == [1] * docs.where("source = 's2'").count()
    out = mixing.replicate(odd_docs)
    assert out.columns == [*odd_docs.columns, "copy", "shuffle_key"]
    assert None not in {r.doc_id for r in out.collect()}
    assert mixing.replicate(odd_docs.limit(0)).count() == 0
