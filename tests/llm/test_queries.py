"""The query contracts on the small tables, against plain Python, brute force or held-out labels."""

import html
import os
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from guestlens.llm import language_id, lm_scoring, queries
from tests.llm import brute

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


def read(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pandas()


@pytest.fixture(scope="module")
def docs():
    return read("documents")


def held(doc, modulus, rest):
    return zlib.crc32(str(doc).encode()) % modulus == rest


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_exact_ones(spark, docs):
    rows = list(zip(docs.doc_id.tolist(), docs.text.tolist()))
    bench = read("benchmark")
    assert rows_of(queries.op1_ngram_join(spark, SF)) == sorted(brute.ngram_join(rows), key=repr)
    assert rows_of(queries.op2_decontaminate(spark, SF)) == brute.decontaminate(rows, list(zip(bench.item_id.tolist(), bench.text.tolist())))
    assert rows_of(queries.op10_substring_dedup(spark, SF)) == brute.substring_dedup(rows)


@pytest.mark.parametrize("name", ["op3_chat_perspectives", "op5_mix_sources", "op10_substring_dedup"])
def test_sql_agrees(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF)
    cols = ", ".join(f'"{c}"' for c in df.columns)
    exact = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
    assert sorted(map(exact, df.collect()), key=repr) == sorted(map(exact, con.sql(f"SELECT {cols} FROM ({queries.ORACLE[name]})").fetchall()), key=repr)


def test_language_on_held_out(spark, docs):
    got = queries.op8_language_id(spark, SF).toPandas().merge(docs, on="doc_id")
    assert (got.held_out == [held(i, 4, 2) for i in got.doc_id]).all()
    out = got[got.held_out & got.lang.notna()]
    assert (out.lang == out.lang_pred).mean() >= 0.95


def test_language_of_words_in_mixed_text(spark, docs):
    some = docs[docs.lang.isin(["en", "de"])].head(60)
    model = language_id.fit([t.encode() for t in some.text], [int(x == "en") for x in some.lang], ["de", "en"])
    de, en = (" ".join(docs[docs.lang == x].text.iloc[-1].split()[:40]) for x in ("de", "en"))
    labels = [x for _, x in language_id.label_words(de + " " + en, model)]
    half = len([x for x, _ in language_id.label_words(de, model)])
    assert labels[:half].count("de") >= 0.85 * half and labels[half:].count("en") >= 0.85 * (len(labels) - half)


def test_marginals_are_those_of_the_whole_chain():
    rng = np.random.default_rng(3)
    emit, start, moves = rng.normal(size=(300, 3)), rng.normal(size=3), rng.normal(size=(3, 3))
    count = np.array([1, 200, 64, 35])
    got = language_id.marginals(emit, count, start, moves)
    at = 0
    for n in count:
        e, m = np.exp(emit[at:at + n]), np.exp(moves)
        f, b = [np.exp(start) * e[0]], [np.ones(3)]
        for t in range(1, n):
            f.append((f[-1] / f[-1].sum()) @ m * e[t])
            b.append(m @ (e[n - t] * b[-1] / b[-1].sum()))
        p = np.array(f) * np.array(b[::-1])
        assert np.allclose(got[at:at + n], p / p.sum(1, keepdims=True))
        at += n


def test_language_model(spark, docs):
    got = queries.op4_lm_scoring(spark, SF).toPandas()
    assert (got.held_out == [held(i, 7, 2) for i in got.doc_id]).all()
    out = got[got.held_out]
    assert out.score.sum() > out.base_score.sum()


@pytest.fixture(scope="module")
def small_model():
    rng = np.random.default_rng(1)
    h = rng.integers(-2**62, 2**62, 40)
    codes = [(5, 900, 30), (9, 70, 12), (11, 40, 8)] + [(100 + i, 3000 // (i + 1), 1) for i in range(40)]
    c = lm_scoring.make_units((h, np.array([3000 // (i + 1) for i in range(40)]), 100 + np.arange(40)), codes, 77)
    theta = lm_scoring.first_model(c)
    return c, {k: v + rng.normal(0, 0.4, v.shape).astype(np.float32) if "+" not in k else v for k, v in theta.items()}


def test_language_model_is_normalised(small_model):
    """Probabilities of all units after a context sum to one and equal a plain softmax in two steps."""
    c, theta = small_model
    assert c.n == 40 + 2 + 2 and c.count.sum() == c.tokens and c.begin[-1] == c.n and (np.diff(c.count) <= 0).all()
    group = np.repeat(np.arange(len(c.begin) - 1), np.diff(c.begin))
    for one, two in ((c.n, c.n), (3, c.n), (0, 17), (c.end, 2)):
        got = lm_scoring.log_probabilities(theta, c, np.arange(c.n), np.full(c.n, one), np.full(c.n, two))
        h = np.append(theta["q"][one] @ theta["c"][:lm_scoring.SIZE] + theta["q"][two] @ theta["c"][lm_scoring.SIZE:], 1).astype(float)
        of_group, of_unit = np.exp(theta["u"] @ h), np.exp(theta["r"] @ h)
        plain = [of_group[g] / of_group.sum() * of_unit[w] / of_unit[group == g].sum() for w, g in enumerate(group)]
        assert np.allclose(10.0 ** got, plain, rtol=1e-4) and abs(sum(10.0 ** got) - 1) < 1e-4


def test_contrastive_gradient(small_model):
    """The gradients are those of the noise-contrastive likelihood, by differences."""
    c, theta = small_model
    rng = np.random.default_rng(2)
    unit, noise = rng.integers(0, c.n, 6), rng.integers(0, c.n, 4)
    log_noise = np.log(4 * (c.count + 1) / (c.count + 1).sum()).astype(np.float32)
    h = lm_scoring.context(theta, rng.integers(0, c.n, 6), rng.integers(0, c.n, 6))[0]

    def likelihood(h, table):
        odds = lambda t, w: 1 / (1 + np.exp(-(h[t].astype(float) @ table[w] - log_noise[w])))
        return sum(np.log(odds(t, w)) + sum(np.log(1 - odds(t, x)) for x in noise) for t, w in enumerate(unit))
    rows, grad, back = lm_scoring.contrast(h.copy(), theta["r"].copy(), unit, noise, log_noise)
    whole = np.zeros(theta["r"].shape)
    np.add.at(whole, rows, grad)
    table = theta["r"].astype(float)
    for at in [(unit[0], 0), (noise[1], 3), (unit[4], lm_scoring.SIZE)]:
        step = np.zeros(table.shape)
        step[at] = 1e-4
        assert abs((likelihood(h, table + step) - likelihood(h, table - step)) / 2e-4 - whole[at]) < 1e-3
    for at in [(0, 0), (5, 7)]:
        step = np.zeros(h.shape)
        step[at] = 1e-4
        assert abs((likelihood(h + step, table) - likelihood(h - step, table)) / 2e-4 - back[at]) < 1e-3


def test_language_model_works_once_on_a_word(small_model, monkeypatch):
    """Units are looked up once for each distinct word of a block, endings only of words without a unit of their own."""
    c, theta = small_model
    text = b" ".join([b"The cat saw", *[b"the cat"] * 500, b"SAW dogs"])
    data, w = lm_scoring._block_words(pa.table({"text": pa.array([text, None, b"the"], pa.binary())}))
    order, starts = lm_scoring._distinct(w)
    word = lambda at: data[w.start[at]:w.end[at]].tobytes().lower()
    hashes = {word(x): w.hash[x] for x in order[starts]}
    own = np.sort(np.array([hashes[b"the"], hashes[b"cat"], *c.words[:20]]))
    c = c._replace(words=own, number=np.arange(len(own)))
    asked = []
    monkeypatch.setattr(lm_scoring, "endings", lambda data, w, at=slice(None), f=lm_scoring.endings: (asked.append(len(w.hash[at])), f(data, w, at))[1])
    left = pa.table({"id": [1, 2, 3], "learn": [True] * 3, "text": pa.array([text, None, b"the"], pa.binary())})
    right = pa.table({"bucket": [0], "counts": [np.arange(len(starts), dtype=np.int64).tobytes()]})
    got = lm_scoring._score(left, right, c, theta, 1)
    assert sum(asked) == 2 and got.column("n_tokens").to_pylist() == [1006, 1, 2]      # saw and dogs
    unit, known = lm_scoring.unit_of(data, w, c)
    plain = [(np.flatnonzero(own == h)[0], True) if h in own else (c.of_code[lm_scoring.endings(data, w, [x])[0]], False) for x, h in enumerate(w.hash)]
    assert list(zip(unit, known)) == plain and sum(asked[1:]) < 10
    out, one, two, _ = lm_scoring.sequence(unit, w.count, c)
    log = lm_scoring.log_probabilities(theta, c, out, one, two)
    assert got.column("score")[1].as_py() == pytest.approx(log[-3])


@pytest.mark.parametrize("scale", [1, 5])
def test_language_model_is_exact_at_large_scores(small_model, scale):
    """Sums of exponentials and steps of the fit stay right where exp leaves single precision."""
    c, theta = small_model
    theta = {k: v if "+" in k else v * np.float32(scale) for k, v in theta.items()}
    rng = np.random.default_rng(5)
    out, one, two = rng.integers(0, c.n, 300), rng.integers(0, c.n + 1, 300), rng.integers(0, c.n + 1, 300)
    got = lm_scoring.log_probabilities(theta, c, out, one, two)
    h = lm_scoring.context(theta, one, two)[0]
    group = np.repeat(np.arange(len(c.begin) - 1), np.diff(c.begin))
    most, plain = 0, np.zeros(300)
    for t in range(300):
        same = np.flatnonzero(group == group[out[t]])
        for table, rows, at in ((theta["u"], slice(None), group[out[t]]), (theta["r"], same, out[t] - same[0])):
            s = table[rows].astype(float) @ h[t].astype(float)
            most = max(most, s.max())
            plain[t] += (s[at] - s.max() - np.log(np.exp(s - s.max()).sum())) / np.log(10)
    assert (most > 100) == (scale > 1) and np.allclose(got, plain, rtol=1e-4, atol=1e-3)
    log_noise = np.log(8 * (c.count + 1) / (c.count + 1).sum()).astype(np.float32)
    rows, grad, back = lm_scoring.contrast(h, theta["r"], out, rng.integers(0, c.n, 8), log_noise)
    assert np.isfinite(grad).all() and np.isfinite(back).all()
    whole = np.zeros(theta["r"].shape)
    np.add.at(whole, rows, grad)
    at, total = lm_scoring.merge(rows, grad.copy(), np.empty(c.n, np.int64))
    assert sorted(at) == sorted(set(rows)) and np.allclose(total, whole[at], rtol=1e-4, atol=1e-3 * scale)


def test_parameters_of_partitions_are_averaged_by_use():
    rng = np.random.default_rng(3)
    start = {"q": rng.normal(size=(150_000, 3)).astype(np.float32), "q+": rng.normal(size=(150_000, 1)).astype(np.float32)}
    fits = []
    for seed in range(3):
        used = np.where(rng.random(150_000) < 0.5, rng.integers(1, 9, 150_000), 0)
        fits.append(({k: v + np.float32(seed + 1) * (used > 0)[:, None] for k, v in start.items()}, {"q": used}))
    width = {k: v.shape[1] for k, v in start.items()}
    first = [list(lm_scoring._mean((b for f in some for b in lm_scoring._pieces(*f)), width)) for some in (fits[:2], fits[2:])]
    whole = {k: v.copy() for k, v in start.items()}
    for batch in lm_scoring._mean((b for some in first for b in some), width):
        lm_scoring.put(whole, [tuple(r.values()) for r in batch.to_pylist()])
    use = sum(u["q"] for _, u in fits)
    for k, v in start.items():
        plain = sum(u["q"][:, None] * t[k].astype(float) for t, u in fits) / np.maximum(use, 1)[:, None]
        assert np.allclose(whole[k], np.where((use > 0)[:, None], plain, v), atol=1e-5)


def test_language_model_learns_words(spark):
    """Two vocabularies that never meet: the context tells which; frequent words have units of their own."""
    rng = np.random.default_rng(4)
    lines = [" ".join(f"{kind}{x}" for x in rng.integers(0, 12, 400)) for kind in ("left", "right") for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = lm_scoring.score_texts(df, queries.F.col("doc_id") % 5 != 0).toPandas()
    out = got[got.held_out]
    assert (out.n_known == out.n_tokens).all()
    assert (out.score - out.base_score).sum() / out.n_tokens.sum() > 0.2            # of log10(2) = 0.30


def test_quality_on_held_out(spark):
    got = queries.op7_quality(spark, SF).toPandas().merge(read("labels"), on="doc_id")
    assert (got.held_out == [held(i, 5, 0) for i in got.doc_id]).all()
    out = got[got.held_out]
    assert (out.predicted == out.quality).mean() >= 0.85


def test_nearest_recall(spark):
    got = queries.op9_nearest(spark, SF).toPandas()
    e = read("embeddings")
    x, ids = np.stack(e.embedding.values).astype(float), e.vec_id.values
    found = total = 0
    for q in ids[ids % 20 == 0]:
        near = x @ x[ids == q][0]
        near[ids == q] = -np.inf
        best = ids[np.lexsort((ids, -near))[:20]]
        own = got[got.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21))
        found += len(set(best) & set(own.vec_id))
        total += 20
    assert found >= 0.9 * total


def test_pages_have_their_article(spark):
    """Whole texts: the blocks of each page's article that the page does not mark as something else."""
    got = {r.page_id: r.text for r in queries.op6_html_extract(spark, SF).collect()}
    same = 0
    for page, raw in zip(read("pages").page_id, read("pages").html):
        inside = raw.partition("<article>")[2].partition("</article>")[0]
        inside = re.sub(r"(?is)<(script|style|nav|aside|footer|form)\b.*?</\1>|<!--.*?-->", "", inside)
        inside = re.sub(r"(?is)<div class=.?(?:ad|share|related|comments)\b.*?</div>", "", inside)
        inside = re.sub(r"(?i)</?(?:p|h[1-6]|li|ul|ol|div|blockquote|pre|td|tr|table|section|header|figure|figcaption)\b[^>]*>", "\0", inside)
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in inside.split("\0"))
        same += got[page] == "\n".join(x for x in blocks if x)
        assert "©" not in got[page] and "track(" not in got[page]
    assert same == len(got)


def test_pipeline(spark, docs):
    """The stages against plain Python, each on what the one before kept."""
    out = corpus_pipeline.run(spark, SF).toPandas()
    rows = list(zip(docs.doc_id.tolist(), docs.text.tolist()))
    rows = [r for r in rows if r[1] and any(map(str.isalpha, r[1]))]
    stay = {i for i, _, c in brute.ngram_join(rows, 5, 4, 5) if i == c}
    rows = [r for r in rows if r[0] in stay]
    cut = {i: n for i, _, n, _ in brute.substring_dedup(rows, corpus_pipeline.PASSAGE)}
    bench = read("benchmark")
    leak = {r[0] for r in brute.decontaminate(rows, list(zip(bench.item_id.tolist(), bench.text.tolist()))) if r[5]}
    whole = {i: t for i, t in rows if cut[i] == 0 and i not in leak}
    got = dict(zip(out.doc_id, out.text))
    assert set(got) <= stay and all(got[i] == t for i, t in whole.items() if i in got)
    assert not {i for i in leak if cut[i] == 0} & set(got)
    assert abs(out.taken.sum() - out.groupby("source").target.first().sum()) <= 0.5 * out.source.nunique()
