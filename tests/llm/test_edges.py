"""Every operator and stage on awkward tables: nulls in any column, empty and very long
texts, ties and repeated rows, empty tables, extra columns with the names of results."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from guestlens.llm import (chat, decontaminate, html_extract, language_id, lm_scoring, mixing, nearest, ngram_join, quality, substring_dedup)
from tests.llm import brute

PASSAGE = " ".join(f"w{i}" for i in range(60))
LONG = " ".join(f"x{i % 977}y{i % 13}" for i in range(40_000))
EN = "the cat and the dog went over to the house of the old man in the morning "
DE = "der Hund und die Katze gingen am Morgen über die Straße zu dem Haus des alten Mannes "
ROWS = [
    (1, PASSAGE + " alpha", "en", "a"), (2, PASSAGE + " alpha", "en", "a"), (2, PASSAGE + " alpha", "en", "a"),
    (3, "before " + PASSAGE + " after that came more words of another kind", "en", None), (4, None, "en", "a"), (5, "", None, "b"),
    (6, " \n\t ", "en", "b"), (7, "one", "en", "b"), (8, "One", "en", "b"), (9, "one two", None, None), (None, PASSAGE + " alpha", "en", "a"),
    (None, None, None, None), (10, LONG, "en", "c"), (11, LONG + " tail", "en", "c"), (12, "??? !!! 123", "de", "c"),
    (13, "ein zwei drei " * 30, "de", "c"), (14, "Äpfel über Öl " * 5, "de", "c"), (15, EN * 4, "en", "a"), (16, DE * 4, "de", "b"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
EXTRA = {"n_words": "x", "size": "y", "node": 1, "id": 2, "score": "z", "row": 3, "bucket": "q", "kept": "k", "component_id": "c", "lang_pred": "l",
         "taken": "t", "contaminated": 0, "learn": "?", "__row": 9}


def table(spark, rows=ROWS):
    return spark.createDataFrame(rows, SCHEMA).withColumns({k: F.lit(v) for k, v in EXTRA.items()})


def rows_of(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_ngram_join(spark):
    got = rows_of(ngram_join.similarity_classes(table(spark), k=3, num=90, den=100).where("doc_id is not null"), "doc_id", "n_shingles", "component_id")
    assert got == sorted(brute.ngram_join([r[:2] for r in ROWS]), key=repr)
    nulls = rows_of(ngram_join.similarity_classes(table(spark), k=3, num=90, den=100).where("doc_id is null"), "n_shingles", "component_id")
    assert nulls == [(0, None), (59, None)]


def test_ngram_join_keeps_links_of_large_groups(spark):
    # Near copies of one text, each with words of its own, and texts that only share its opening.
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(40):
        words = list(base)
        words[(7 * i) % 120] = f"own{i}"
        if i % 3 == 0:
            words[(31 * i) % 120] = f"more{i}"
        rows.append((100 + i, " ".join(words)))
    rows += [(200 + i, " ".join(base[:25] + [f"t{i}_{j}" for j in range(90)])) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for k, num, den in ((3, 90, 100), (5, 4, 5)):
        got = rows_of(ngram_join.similarity_classes(df, k=k, num=num, den=den), "doc_id", "n_shingles", "component_id")
        assert got == sorted(brute.ngram_join(rows, k, num, den), key=repr)


def test_decontaminate(spark):
    items = [(1, " ".join(f"w{i}" for i in range(5, 30))), (2, "Two"), (3, None), (4, ""), (None, "one two"), (2, "Two"), (5, "ÄPFEL über")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.decontaminate(table(spark), bench)
    out = out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256), "contaminated", "spans", "text")
    got = [tuple(r) for r in out.collect()]
    assert sorted((r[:6] for r in got), key=repr) == brute.decontaminate([r[:2] for r in ROWS], [x for x in items if x[0] is not None])
    spans = {r[0]: [r[7][s["start"]:s["end"]] for s in r[6]] for r in got if r[0] in (9, 3)}
    assert spans == {9: ["two"], 3: [" ".join(f"w{i}" for i in range(5, 30))]}


def test_decontaminate_in_shards(spark, monkeypatch):
    items = [(i, " ".join(f"w{j}" for j in range(i, i + 12))) for i in range(0, 40, 5)] + [(99, "zwei drei ein")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    cols = ("doc_id", "n_words", "n_hit", "n_items", "items", "spans", "contaminated")
    one = rows_of(decontaminate.decontaminate(table(spark), bench), *cols)
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 150)
    assert rows_of(decontaminate.decontaminate(table(spark), bench), *cols) == one


def test_decontaminate_without_items(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    out = decontaminate.decontaminate(table(spark), bench)
    assert out.where("contaminated or n_hit > 0 or n_items > 0").count() == 0 and out.count() == len(ROWS)


def test_substring_dedup(spark):
    out = substring_dedup.remove_repeats(table(spark))
    assert rows_of(out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)), "*") == brute.substring_dedup([r[:2] for r in ROWS])
    spans = {r.doc_id: [tuple(s) for s in r.spans] for r in out.where("doc_id in (2, 3)").collect()}
    assert spans == {2: [(0, 61, 1, 0)], 3: [(1, 61, 1, 0)]}


def test_substring_dedup_over_many_blocks(spark, monkeypatch):
    from guestlens.llm import blocks
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", 2000)
    rows = [(i, " ".join(f"a{(i * j) % 17}" for j in range(5 + i % 60)) + " " + (PASSAGE if i % 4 == 0 else "")) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    for k in (2, 13, 20):
        out = substring_dedup.remove_repeats(df, k=k).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256))
        assert rows_of(out, "*") == brute.substring_dedup(rows, k)
    assert blocks.BLOCK_BYTES > 0


def test_mix(spark):
    got = mixing.mix(table(spark), carry=["lang", "size"]).toPandas()
    assert len(got) == len(ROWS) and list(got.columns) == ["doc_id", "lang", "size", "source_size", "target", "taken"]
    sizes = {}
    for _, text, _, source in ROWS:
        sizes[source] = sizes.get(source, 0) + len(brute.plain_words(text))
    assert got.groupby("source_size").target.first().to_dict().keys() == set(sizes.values())
    assert abs(sum(got.groupby("source_size").target.first()) - sum(sizes.values())) < 1e-6
    assert (got.taken <= 3 * got["size"]).all()
    for (size, target), own in got.groupby(["source_size", "target"]):
        assert abs(own.taken.sum() - target) <= 0.5 and target <= 3 * size + 1e-9
    again = mixing.mix(table(spark).repartition(5)).toPandas()
    assert sorted(again.taken) == sorted(got.taken)


def test_language(spark):
    df = table(spark)
    model = language_id.train(df, F.lit(True))
    out = language_id.identify(df, model, carry=df.columns)
    got = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in out.collect()}
    assert out.count() == len(ROWS) and model.langs == ["de", "en"]
    assert all(got[k] == ("und", 0.0) for k in ((4, None), (5, ""), (6, " \n\t "), (12, "??? !!! 123"), (None, None)))
    assert got[(15, EN * 4)][0] == "en" and got[(16, DE * 4)][0] == "de" and all(0 <= s <= 1 for _, s in got.values())
    nothing = language_id.train(df.where("false"), F.lit(True))
    assert {r.lang_pred for r in language_id.identify(df, nothing).collect()} == {"und"}


def test_language_fit_takes_300_a_language_in_blocks(monkeypatch):
    assert language_id.PER_LANG == 300
    texts = [(w * (i % 7 + 1)).encode() for i in range(40) for w in (EN, DE)]
    one = language_id.fit(texts, [0, 1] * 40, ["en", "de"], steps=4)
    monkeypatch.setattr(language_id, "FIT_BLOCK", 500)
    most, words = [0], language_id.B.words
    monkeypatch.setattr(language_id.B, "words", lambda data, *a: (most.append(len(data)), words(data, *a))[1])
    many = language_id.fit(texts, [0, 1] * 40, ["en", "de"], steps=4)
    assert abs(one.weights - many.weights).max() < 1e-4 and abs(one.moves - many.moves).max() < 1e-4 and 0 < max(most) < 500 + max(map(len, texts))


def test_language_sample_of_copies_and_long_texts(spark, monkeypatch):
    got = []
    real = language_id.fit
    monkeypatch.setattr(language_id, "fit", lambda texts, labels, langs: got.append((texts, [langs[i] for i in labels])) or real(texts, labels, langs, steps=2))
    few = [("es", f"el perro y el gato {chr(97 + i)}") for i in range(5)] * 4000        # few texts, many copies
    hot = [("en", EN)] * 5000 + [("en", EN + f"word{i}") for i in range(900)]
    far = [("de", "... " + DE * 300 + f"wort{i}") for i in range(30)]                  # longer texts only
    df = spark.createDataFrame(few + hot + far, "lang string, text string")
    model = language_id.train(df, F.lit(True))
    texts, langs = got[0]
    assert model.langs == ["de", "en", "es"]
    assert langs.count("es") == 5 and langs.count("en") == 300 and langs.count("de") in range(1, 31)
    assert len({(a, b) for a, b in zip(texts, langs) if b != "de"}) == 305 and all(len(t) <= language_id.FIT_BYTES for t in texts)


def test_language_model_and_quality(spark):
    df = table(spark)
    learn = F.coalesce(F.col("doc_id") % 2 == 1, F.lit(False))
    got = lm_scoring.score_texts(df, learn).toPandas()
    tokens = [brute.lower(x) for i, t, _, _ in ROWS if i is not None and i % 2 for x in brute.plain_words(t)]
    docs = sum(1 for r in ROWS if r[0] is not None and r[0] % 2)
    assert len(got) == len(ROWS) and set(got.train_tokens) == {len(tokens) + docs}
    n, v = len(tokens) + docs, len(set(tokens)) + 1
    for (i, text, _, _) in ROWS:
        if i is None:
            continue
        words = [brute.lower(x) for x in brute.plain_words(text)]
        if len(words) > 1000:
            continue
        counts = [tokens.count(x) for x in words] + [docs]
        row = got[got.doc_id == i].iloc[0]
        assert row.n_tokens == len(words) + 1 and row.n_known == sum(c > 0 for c in counts)
        assert row.base_score == pytest.approx(sum(math.log10((c + 1) / (n + v + 1)) for c in counts))
        assert row.score < 0 and math.isfinite(row.score)
    none = lm_scoring.score_texts(df, F.lit(False)).toPandas()
    assert set(none.train_tokens) == {0} and len(none) == len(ROWS)

    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 1), (13, 0), (15, None), (None, 1), (99, 0)], "doc_id long, quality int")
    stats = quality.describe(df, learn, "doc_id", "text")
    out = quality.score(stats, quality.train(stats, labels)).toPandas()
    assert len(out) == len(ROWS) and out.score.between(0, 1).all() and ((out.score >= 0.3) == (out.predicted == 1)).all()
    assert set(quality.score(stats, quality.train(stats, labels.where("false"))).toPandas().score) == {0.5}


def test_pages(spark):
    pages = [(1, "u", "<nav>a b</nav><article><p>x &amp; y<p>second\n line <b>bold</article><footer>f</footer>"), (1, "u", None), (None, None, ""),
             (2, "u", "plain text"), (3, "u", "<div class='cookie-notice'>we use</div><main><h1>T</h1><form>q</form><script>var a='<p>';</script><p>body</main>"),
             (4, "u", "<article><p>cut in the middle <a href="), (5, "u", "<p>" + LONG), (6, "u", "<![bad <p>text</p>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({"text": F.lit(1), "n_chars": F.lit("x")})
    got = {(r.page_id, r.url, r.text[:40], r.n_chars) for r in html_extract.extract(df).collect()}
    assert {(1, "u", "x & y\nsecond line bold", 22), (1, "u", "", 0), (None, None, "", 0), (2, "u", "plain text", 10), (3, "u", "T\nbody", 6),
            (5, "u", LONG[:40], len(LONG))} <= got
    assert len(got) == len(pages)
    assert "text" in {r.text for r in html_extract.extract(df.where("page_id = 6")).collect()}


def test_html_goes_on_after_unknown_declarations():
    for mark in ("<![foo[x]]>", "<![ if x]>", "<![if !IE]>", "<![endif]-->", "<![>", "<![CDATA[a > b]]>", "<![1]>", "<![cdata-x>"):
        for page, text in ((f"<p>one</p>{mark}<p>two</p>", "one\ntwo"), (f"{mark}<p>one</p>", "one")):
            assert html_extract.main_text(page) == text, mark
    assert html_extract.main_text("<p>one</p><![foo").startswith("one")


def test_html_keeps_the_article():
    text = "a long paragraph of the article, with words enough to be content of the page by its ratio"
    for names in ("content has-sidebar", "post no-comments", "article-header", "content-sidebar-wrap", "with-widgets", "postHeader"):
        assert html_extract.main_text(f"<div class='{names}'><p>{text}</p></div>") == text, names
    for names in ("sidebar", "site-header", "main-nav", "comments-area", "comment-list", "cookie-notice", "ad", "post-comments", "siteFooter"):
        assert html_extract.main_text(f"<p>{text}</p><div class='{names}'><p>{text} not</p></div>") == text, names
    for before, after in (("<form>", "</form>"), ("<div class='banner'>", "</div>"), ("<div id=sidebar>", "</div>")):
        assert html_extract.main_text(f"{before}menu<main><p>{text}</p></main>{after}") == text, before
    for before, after in (("<nav>", "</nav>"), ("<aside>", "</aside>"), ("<footer>", "</footer>"), ("<div class=comments>", "</div>"), ("<div class=related>", "</div>"),
                          ("<div hidden>", "</div>")):
        assert html_extract.main_text(f"<p>{text}</p>{before}<article><p>{text} not</p></article>{after}") == text, before
    page = "<article><h1>T</h1><ul><li><a href=x>one source</a></li><li><a href=y>another</a></li></ul><table><tr><td><a href=z>cell</a></td><td>2</td></tr></table></article>"
    assert html_extract.main_text(page) == "T\none source\nanother\ncell\n2"
    formula = "<math><semantics><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></semantics></math>"
    assert html_extract.main_text(f"<article><p>so {formula} holds <map name=m><area>here</map></p></article>") == "so x=2 holds here"
    assert html_extract.main_text("<article><div class=header><h1>T</h1></div><p>body</p></article>") == "T\nbody"


def test_nearest(spark):
    rows = [(i, [float((i * j * 7919) % 31 - 15) for j in range(1, 9)]) for i in range(1, 60)]
    rows += [(100 + i, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0]) for i in range(50)]
    bad = [(200, None), (220, [0.0] * 8), (240, [float("nan")] + [1.0] * 7), (260, [None] + [1.0] * 7), (280, [float("inf")] + [1.0] * 7), (300, [1.0]), (None, [1.0] * 8), (40, rows[39][1])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumns({"id": F.lit("x"), "x": F.lit(1), "score": F.lit(2)})
    got = nearest.search(df, F.col("vec_id") % 20 == 0).collect()
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(by) == {20, 40, 100, 120, 140}
    found = total = 0
    for q, near in by.items():
        x = dict(rows)[q]
        best = sorted(((-sum(a * b for a, b in zip(x, y)), i) for i, y in rows if i != q))[:20]
        assert [(-s, i) for i, s in near] == sorted((-s, i) for i, s in near) and len(near) == 20 and q not in dict(near)
        found += len({i for _, i in best} & {i for i, _ in near})
        total += 20
    assert found >= 0.9 * total
    tied = [i for i, _ in by[100] if i >= 100]
    assert tied == [101 + i for i in range(len(tied))] and len(tied) >= 5       # ties: the smaller ids
    assert nearest.search(df.where("false"), F.lit(True)).count() == 0


def test_nearest_finds_all_candidates(spark):
    rng = random.Random(3)
    unit = lambda: [rng.gauss(0, 1) for _ in range(8)]
    small = [(i, unit()) for i in range(12)]                                           # fewer than 20 candidates
    far = [(i, [5 + 0.01 * x for x in unit()]) for i in range(400)] + [(1000, [-3.0] * 4 + [2.0] * 4), (1001, [-0.5] * 8)]
    for rows, asks, n in ((small, F.lit(True), 11), (far, F.col("vec_id") >= 1000, 20)):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        got = {}
        for r in nearest.search(df, asks).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
        assert len(got) == (12 if rows is small else 2)
        for q, ids in got.items():
            x = dict(rows)[q]
            assert ids == [i for _, i in sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in rows if i != q)][:n]


def test_chat(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "bob", None), (1, 2, "bob", None), (1, None, None, "late"), (2, 0, "system", "alone"),
            (None, 0, "user", "lost"), (3, 5, "user", ""), (4, 0, "user", LONG)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"perspective": F.lit(1), "part": F.lit(2), "piece": F.lit("x")})
    out = chat.perspectives(df).orderBy("conv_id", "perspective", "seq").collect()
    assert {(r.conv_id, r.perspective) for r in out} == {(1, "user"), (1, "bob"), (1, "unknown"), (3, "user"), (4, "user")}
    for key in {(r.conv_id, r.perspective) for r in out}:
        own = [r for r in out if (r.conv_id, r.perspective) == key]
        whole = "".join(r.piece for r in own)
        assert [r.seq for r in own] == list(range(len(own)))
        for r in own:
            assert whole[r.start:r.start + len(r.piece)] == r.piece
            if r.is_target:
                said = next(x for x in rows if x[0] == r.conv_id and (x[2] or "unknown") == r.speaker)[3] or ""
                assert whole[r.mask_start:r.mask_end] == said + "<|im_end|>" and r.piece.startswith("<|im_start|>assistant\n")
            else:
                assert r.mask_start is None and (r.speaker == "system" or r.piece.startswith(f"<|im_start|>user name={r.speaker}\n"))
    assert chat.perspectives(df.where("false")).count() == 0


def test_empty_tables(spark):
    df = table(spark).where("false")
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    stats = quality.describe(df, F.lit(True), "doc_id", "text")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for out in (ngram_join.similarity_classes(df), decontaminate.decontaminate(df, bench), substring_dedup.remove_repeats(df), mixing.mix(df),
                language_id.identify(df, language_id.train(df, F.lit(True))), lm_scoring.score_texts(df, F.lit(True)),
                quality.score(stats, quality.train(stats, labels)), html_extract.extract(pages)):
        assert out.count() == 0 and out.columns


def test_stages(spark, tmp_path):
    spark.createDataFrame([(1, "zwei drei ein zwei drei ein zwei drei ein zwei")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = table(spark).withColumn("n_chars", F.length("text").cast("long"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and stage(spark, docs.where("false"), str(tmp_path)).count() == 0
    said, near, sub, leak, mixed = (f for _, f in corpus_pipeline.STAGES)
    ids = lambda f: sorted((r.doc_id for r in f(spark, docs, str(tmp_path)).collect()), key=str)
    assert not {4, 5, 6, 12} & set(ids(said)) and {1, 2, 15, 16} <= set(ids(said))
    kept = ids(near)
    assert 1 in kept and 2 not in kept and 11 not in kept and 3 not in kept and {9, 15, 16} <= set(kept) and kept.count(None) == 2
    texts = {r.doc_id: (r.text, r.n_chars) for r in sub(spark, docs, str(tmp_path)).collect() if r.doc_id}
    assert 2 not in texts and texts[1][0] == ROWS[0][1] and texts[3][0].startswith("before after that") and texts[3][1] == len(texts[3][0])
    assert 13 not in ids(leak) and 14 in ids(leak)
    took = mixed(spark, docs, str(tmp_path))
    assert took.where("taken <= 0").count() == 0 and set(docs.columns) - {"size", "taken"} <= set(took.columns)
    assert mixed(spark, docs.where("false"), str(tmp_path)).count() == 0


def test_line_breaks_part_words():
    page = "<article><p>one<br class=x>two<br clear='all' />three<BR/>four<br title='a > b'>five<broken>six</p></article>"
    assert html_extract.main_text(page) == "one two three four five\nsix"      # another tag's name may begin alike


def test_html_of_many_unclosed_tags_takes_time_in_proportion():
    for page in ("<b>x</i>" * 50_000, "<div>x</section>" * 50_000, "<i><div>" + "<b>x</i>" * 50_000, "<p><b>x" * 50_000):
        start = time.process_time()
        assert html_extract.main_text(page).count("x") == 50_000
        assert time.process_time() - start < 20


def test_html_ratios_choose_articles_whole():
    long = "a long paragraph with words enough to be content of the page by its ratio of text to tags"
    assert html_extract.main_text(f"<article><h2>T</h2><div><p>ok</p></div><p>{long}</p><div><ul><li>one<li>two</ul></div></article>") == f"T\nok\n{long}\none\ntwo"
    poor = "<article>" + "".join(f"<p><b><i>{x}</i></b></p>" for x in "abcdefgh") + "</article>"
    assert html_extract.main_text(f"<div><p>{long}</p><p>{long}</p><p>{long}</p></div>{poor}") == "\n".join([long] * 3)
