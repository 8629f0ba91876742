"""Classifier, rules, language, WARC and HTML: held-out accuracy, brute force, exact round trips."""

import base64
import collections
import hashlib
import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from newsfunnel.llm import op5_quality_rules as rules
from newsfunnel.llm import op7_warc as warc
from newsfunnel.llm import op8_html_text as pages, tokens
from newsfunnel.llm.op4_quality_classifier import classify, expectation_maximisation
from newsfunnel.llm.op6_language import _sample_each, fit_temperature, identify_languages, softmax

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, p_junk int, keep string, row string"


def test_em_finds_labellers_accuracies():
    rng = np.random.default_rng(3)
    truth = rng.random(20000) < 0.2
    right = np.array([0.95, 0.8, 0.7, 0.9])
    votes = np.where(rng.random((20000, 4)) < right, truth[:, None], ~truth[:, None]) * 2 - 1
    votes[rng.random((20000, 4)) < 0.3] = 0
    votes[:, 3] = np.where(votes[:, 3] == 1, 1, 0)  # one labeller only ever says yes
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    post, rates = expectation_maximisation(patterns, counts.astype(float), 0.3)
    for j in range(3):
        said = rates[j, 1, 0] + rates[j, 1, 2]
        assert abs(rates[j, 1, 2] / said - right[j]) < 0.03
    assert ((post[inverse.ravel()] > 0.5) == truth).mean() > 0.93


@pytest.fixture(scope="module")
def judged(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    # Labels of a quarter of the documents are hidden from training.
    hidden = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    got = classify(docs, labels.filter(~hidden))
    return got.join(labels.filter(hidden), "doc_id").toPandas()


def test_classifier_on_hidden_labels(judged):
    clean = judged[(judged.quality == 1) & (judged.toxic == 0)]
    assert clean.keep.mean() > 0.97
    junk = judged[judged.quality == 0]
    assert (~junk.keep).mean() > 0.85


def test_classifier_of_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, None, "en", 5, "k", "r"), (2, "", "en", 5, "k", "r"), (2, " \n", "en", 5, "k", "r"),
         (None, "plain words of a calm text", None, 5, "k", "r"), (3, "plain words of a calm text", None, 5, "k", "r")], SCHEMA)
    labels = spark.createDataFrame([(3, 1, 0), (3, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    got = classify(docs, labels)
    assert got.columns == ["doc_id", "text", "lang", "row", "p_junk", "p_abuse", "keep"]
    assert sorted((r["doc_id"] or 0, r["text"] or "", r["keep"]) for r in got.collect()) == [
        (0, "plain words of a calm text", True), (1, "", False), (2, "", False), (2, " \n", False),
        (3, "plain words of a calm text", True)]
    assert classify(docs.limit(0), labels.limit(0)).collect() == []


def brute_rules(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = collections.Counter(zip(w, w[1:], w[2:]))
    cover = {j for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(cover) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(cover), failed


def test_base_rules_equal_brute_force(spark):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    texts += [None, "", "\n\n", "a b c a b c", "x y z\x0bq\r\nx y z\x0bq", "é ü 語 #1 <b>|x|</b>", "l\nl\n l\nl ", "A a A a A a"]
    df = spark.createDataFrame([(i, t, None if i % 2 else "en", 1, "k", "r") for i, t in enumerate(texts)], SCHEMA)
    got = rules.quality_rules(df).toPandas().set_index("doc_id")
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    for i, t in enumerate(texts):
        assert tuple(got.loc[i, columns]) == brute_rules(t), i
    assert not (got.kept & got.base_failed).any()
    assert rules.quality_rules(df.limit(0)).count() == 0


def test_token_entropy_and_lines():
    assert rules.token_entropy(np.array([1, 1, 1, 1])) == 0
    assert rules.token_entropy(np.arange(10)) == pytest.approx(1)
    assert rules.duplicate_lines("a\nb\na\n\n\na") == 2


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = identify_languages(docs, train_rows=400, calibrate_rows=200).join(
        docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out & got.lang.notna()]
    assert len(held) > 150 and (held.lang == held.lang_pred).mean() > 0.97
    # Calibrated: scores are about as high as predictions are right.
    assert abs(held.score.mean() - (held.lang == held.lang_pred).mean()) < 0.05


def test_language_of_odd_rows(spark):
    rows = [(i, "the words of this", "en", 1, "k", "r") for i in range(20)] + [
        (i, "les mots de cela", "fr", 1, "k", "r") for i in range(20, 40)]
    rows += [(100, None, "en", 1, "k", "r"), (101, "", None, 1, "k", "r"), (102, "12 - 34", None, 1, "k", "r"), (None, "the", "xx", 1, "k", "r")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc_id"]: r for r in identify_languages(df).collect()}
    assert {got[i]["lang_pred"] for i in (100, 101, 102)} == {"und"}
    assert got[None]["held_out"] is False and got[None]["lang_pred"] in ("en", "fr")
    assert all(0 <= r["score"] <= 1 for r in got.values())
    nothing = identify_languages(df.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in nothing.collect()} == {"und"}
    assert identify_languages(df.limit(0)).collect() == []


def test_temperature_softens_what_is_too_sure():
    rng = np.random.default_rng(0)
    logits = rng.normal(size=(4000, 3))
    y = np.array([rng.choice(3, p=p) for p in softmax(logits)])
    assert fit_temperature(logits * 5, y) == pytest.approx(5, rel=0.15)


@pytest.mark.parametrize("chunk", [7, 1 << 20])
def test_archives_round_trip(spark, tmp_path, chunk):
    rng = random.Random(1)
    html = ["<p>" + "".join(rng.choice("aé語😀\r\n<>") for _ in range(rng.randrange(40))) for _ in range(30)]
    html += [None, "", "\r\n\r\n", "WARC/1.1\r\n\r\n", html[3], html[3], "x" * 50]
    rows = [(i, None if i == 4 else f"http://h/{i}\r\nX: y", h, "k") for i, h in enumerate(html)]
    df = spark.createDataFrame(rows + [(None, "http://n/", "no id", "k")], "page_id long, url string, html string, key string")
    path = str(tmp_path / "warc")
    warc.write_archives(df, path, chunk=chunk, file_bytes=4000)
    table = warc.read_archives(spark, path)
    got = {r["page_id"]: tuple(r)[1:] for r in warc.records_of(table).collect()}
    groups = collections.defaultdict(list)
    for i, h in enumerate(html):
        groups[h or ""].append(i)
    for i, h in enumerate(html):
        raw, top = (h or "").encode(), max(groups[h or ""])
        assert got[i] == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(),
                          "response" if i == top else "revisit", None if i == top else top), i
    assert got[None][0] == 5 and len(got) == len(html) + 1
    if chunk == 7:
        assert table.filter("not last").count() > 20


def test_payloads_come_back_byte_for_byte():
    import pyarrow as pa

    html = "é" * 9 + "\r\n\r\n" + "語" * 5
    batch = pa.RecordBatch.from_arrays(
        [pa.array([1]), pa.array(["u"]), pa.array([html]), pa.array([None], pa.int64())], names=list("abcd"))
    raw = b"".join(v.encode() + b"\r\n\r\n" for b in warc._write_rows([batch], 8) for v in b.column(3).to_pylist())
    payload = b""
    for fields, start, end in warc.parse_records(memoryview(raw)):
        body = raw[start:end]
        payload += body.split(b"\r\n\r\n", 1)[1] if fields[b"WARC-Type"] == b"response" else body
    assert payload.decode() == html
    assert [r[1] for r in warc._chunk_rows(raw)] == list(range(len(warc.cut_points(html.encode(), 8)) - 1))
    with pytest.raises(ValueError):
        list(warc.parse_records(memoryview(raw[:-20])))


def test_small_payloads_are_never_revisits(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", "same") for i in range(4)], "page_id long, url string, html string")
    warc.write_archives(df, str(tmp_path / "w"), min_bytes=5)
    assert {r["record_type"] for r in warc.records_of(warc.read_archives(spark, str(tmp_path / "w"))).collect()} == {"response"}
    warc.write_archives(df.limit(0), str(tmp_path / "e"))
    assert warc.records_of(warc.read_archives(spark, str(tmp_path / "e"))).collect() == []


PAGE = """<html><head><title>T &amp; U</title><style>p{{}}</style><script>if (a<b) "</p>"</script></head><body>
<header><a href=/>Home</a> Site of sites</header><nav><ul><li><a href=x>One</a><li><a href=y>Two</a></ul></nav>
<div id="cookie-notice">We use cookies on this site to do things for you and others please accept all of them</div>
<div class="sidebar"><p>Some words in the sidebar that are rather long and go on and on for a while</p></div>
{open}<h1>Head &amp; line</h1><p>First   para <a href=x>with&nbsp;link</a> and<br>more words here to read.
<p>Second para &eacute; &#8364; ok it <b>goes</b> on <div class="advert">Buy now this thing cheap</div>
<p>Third para with<!-- hidden --> list<ul><li>one item<li>two item</ul><form>Subscribe <input> now</form>{close}
<section id=comments><p>nice article thank you very much indeed I liked it a lot yes</p></section>
<footer>bye &copy; site</footer></body></html>"""
TEXT = "Head & line\nFirst para with link and more words here to read.\nSecond para é € ok it goes on\nThird para with list\none item\ntwo item"


@pytest.mark.parametrize("shell", [("<article>", "</article>"), ("<div class=content>", "</div>"), ("<main>", "")])
def test_article_without_the_rest(shell):
    assert pages.extract(PAGE.format(open=shell[0], close=shell[1]), pages.DEFAULT) == TEXT


def test_odd_pages():
    x = lambda p: pages.extract(p, pages.DEFAULT)
    assert x(None) == x("") == x("<p>") == x("<nav>a b c</nav>") == x("<script>a b") == ""
    assert x("just plain\n text") == "just plain text"
    assert x("<p>cut off text here <a href='unclosed") == "cut off text here"
    assert x("<p>a &lt;b&gt; &amp;amp; c</p>") == "a <b> &amp; c"
    assert x("<p>one</p>\n\n<p>one</p>") == "one\none"


def test_best_region_is_the_greatest_sum():
    rng = np.random.default_rng(2)
    for _ in range(200):
        s = rng.integers(-5, 5, 12).astype(float)
        a, b = pages.best_region(s)
        best = max((s[i:j].sum() for i in range(12) for j in range(i + 1, 13)), default=0)
        assert (s[a:b].sum() if b > a else 0) == max(best, 0)


def test_pages_of_the_test_data(spark):
    df = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r for r in pages.extract_pages(df.withColumn("text", F.lit("clash"))).collect()}
    import html as entities

    for r in df.collect():
        inner = re.search(r"<article>(.*?)(</article>|\Z)", r["html"] or "", re.S)[1]
        blocks = [" ".join(entities.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert got[r["page_id"]]["text"] == "\n".join(b for b in blocks if b)
    assert pages.extract_pages(df.limit(0)).collect() == []


@pytest.mark.parametrize("shell", [
    ("<div class='page with-sidebar'>", "</div>"), ("<div id=content class=no-sidebar>", "</div>"),
    ("<article class=has-related>", "</article>"), ("<div class=right-sidebar><article>", "</article></div>"),
    ("<div class=overlay><article>", "</article></div>")])
def test_names_of_what_an_element_has_do_not_drop_the_article(shell):
    assert pages.extract(PAGE.format(open=shell[0], close=shell[1]), pages.DEFAULT) == TEXT


def test_wrapped_blocks_and_headlines_stay():
    wrap = "<div class=elementor-widget-container><p>{}</p></div>"
    blocks = [f"block {i} with a few plain words of text" for i in range(5)]
    body = "".join(wrap.format(b) for b in blocks) + "<div class=sidebar>one or two words aside</div>"
    for begin, end in (("<div>", "</div>"), ("<article>", "</article>")):
        assert pages.extract(begin + body + end, pages.DEFAULT) == "\n".join(blocks)
        head = begin + "<div class=entry-header><h1>The headline</h1></div><p>" + blocks[0] + "</p>" + end
        assert pages.extract(head, pages.DEFAULT) == "The headline\n" + blocks[0]


def test_archives_tell_rows_of_one_id_by_their_payload(spark, tmp_path):
    rows = [(1, "A"), (2, "A"), (1, "BBBB"), (3, "BBBB"), (None, "A"), (4, "C")]
    pages = spark.createDataFrame([(i, "http://x", h) for i, h in rows], "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "w"))
    got = sorted(((r["page_id"] or 0, r["payload_bytes"], r["record_type"], r["refers_to"])
                  for r in warc.records_of(warc.read_archives(spark, str(tmp_path / "w"))).collect()), key=str)
    assert got == sorted([(1, 1, "revisit", 2), (2, 1, "response", None), (1, 4, "revisit", 3), (3, 4, "response", None),
                          (0, 1, "response", None), (4, 1, "response", None)], key=str)


def test_a_repeated_id_does_not_multiply_the_samples(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    one = labels.orderBy("doc_id").first()["doc_id"]
    same = docs.filter(F.col("doc_id") == one)
    many = docs.unionByName(same.crossJoin(spark.range(400)).drop("id"))
    few = {r["doc_id"]: r["keep"] for r in classify(docs, labels).select("doc_id", "keep").collect()}
    got = classify(many, labels).select("doc_id", "keep").collect()
    assert len(got) == len(few) + 400
    assert sum(r["keep"] == few[r["doc_id"]] for r in got) > 0.97 * len(got)
    sizes = identify_languages(many)
    assert sizes.count() == len(got)


def test_every_language_has_its_share_of_the_samples(spark):
    rows = spark.range(3000).select(
        F.col("id").alias("key"), F.when(F.col("id") < 2990, "aa").otherwise("bb").alias("lang"),
        (F.col("id") % 3 == 0).alias("calibrates"))
    sizes = rows.groupBy("lang", "calibrates").count().collect()
    got = _sample_each(rows, sizes, {False: 50, True: 20}).join(rows, "key").groupBy("lang", "calibrates").count().collect()
    assert {(r["lang"], r["calibrates"]): r["count"] for r in got} == {
        ("aa", False): 50, ("aa", True): 20, ("bb", False): 7, ("bb", True): 3}


def test_fallback_is_that_of_whole_texts():
    import public_tokenizers
    import sentencepiece

    from newsfunnel.llm.tokens import PIECE_BPE, PieceBpe

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(PIECE_BPE))
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()
    rng = random.Random(5)
    odd = "a b\n\t  　 ﬁé漢ก\U0001f600 \r<s> x.,"
    texts += ["".join(rng.choice(odd) for _ in range(rng.randrange(0, 40))) for _ in range(3000)] + ["", " ", "  a", " a  b "]
    ours = PieceBpe()
    for t in texts:
        ids = model.encode(t)
        assert ours.counts(t) == (len(ids), sum(map(model.is_byte, ids))), repr(t)


def test_scripts_by_code_points(spark):
    words_of = {"thai": "สวัสดี", "devanagari": "नमस्ते", "tamil": "வணக்கம்", "georgian": "გამარჯობა", "ethiopic": "ሰላም",
                "han": "漢字", "kana": "ひらがな", "hangul": "한국어", "cyrillic": "привет", "latin": "hello", "none": "12 34"}
    df = spark.createDataFrame([(i, f"{t} 1 {t}", "x") for i, t in enumerate(words_of.values())], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["script"] for r in rules.quality_rules(df).collect()}
    assert [got[i] for i in range(len(words_of))] == list(words_of)


def test_bands_and_kept_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = rules.quality_rules(docs).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    from newsfunnel.llm.tokens import ByteBpe

    bpe = ByteBpe()
    text = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    size = {d: int(np.floor(np.log2(max(1, len(bpe.packed(t)) // 4)))) for d, t in text.items()}
    got["size"] = got["doc_id"].map(size)
    measures = {"chars_per_token": 0.1, "token_entropy": 0.02, "byte_fallback_share": 0.01}
    good = got[~got["base_failed"]]

    def band(rows, m, slack):
        v = sorted(rows[m])
        low, high = v[-(-len(v) // 4) - 1], v[-(-3 * len(v) // 4) - 1]
        wide = max(2.0 * (high - low), slack)
        return low - wide, high + wide

    groups = []
    for keys, least in ((["lang", "script", "size"], 100), (["script", "size"], 100), (["size"], 1)):
        groups.append((keys, {k: g for k, g in good.groupby(keys) if len(g) >= least}))
    wrong = 0
    for row in good.itertuples():
        for keys, found in groups:
            rows = found.get(tuple(getattr(row, k) for k in keys))
            if rows is not None:
                break
        else:
            assert row.kept
            continue
        inside = all(a - 1e-12 <= getattr(row, m) <= b + 1e-12 for m, slack in measures.items() for a, b in [band(rows, m, slack)])
        wrong += inside != row.kept
    assert wrong == 0 and not got[got["base_failed"]]["kept"].any() and 0.8 < good["kept"].mean() < 1


def article_of(inner, before="", after=""):
    return f"<html><body><nav><a href=/>Home</a></nav>{before}<article>{inner}</article>{after}<footer>Imprint and terms</footer></body></html>"


BODY = "<p>The first paragraph of the article has a good number of plain words in it.</p>"
BODY_TEXT = "The first paragraph of the article has a good number of plain words in it."


@pytest.mark.parametrize("inner,text", [
    ("<p title=it's>One two three four five six.</p><p>and don't stop here today my friend</p>",
     "One two three four five six.\nand don't stop here today my friend"),
    (BODY + "<p class='share-price'>Shares rose by nine percent on Monday.</p>", BODY_TEXT + "\nShares rose by nine percent on Monday."),
    (BODY + "<div class='social-policy'>Welfare was the topic of the day.</div>", BODY_TEXT + "\nWelfare was the topic of the day."),
    (BODY + "<div id='search-engines'>Crawlers visit pages every night.</div>", BODY_TEXT + "\nCrawlers visit pages every night."),
    (BODY + "<div class='share-buttons'>Share Tweet Mail</div>", BODY_TEXT),
    (BODY + "<div class='newsletter-signup'>Subscribe now</div>", BODY_TEXT),
    (BODY + "<table><tr><td>a</td><td>1</td></tr><tr><td>b</td><td>2</td></tr></table>", BODY_TEXT + "\na\n1\nb\n2"),
    ("<p>The sum <math><mi>x</mi><mo>+</mo><mi>y</mi></math> of both is what we want to know here.</p>",
     "The sum x+y of both is what we want to know here."),
    ('<p data-x="a > b" title = \'c"d\'>Quoted values may hold brackets and quotes of the other kind.</p>',
     "Quoted values may hold brackets and quotes of the other kind."),
])
def test_article_text_stays_whole(inner, text):
    assert pages.extract(article_of(inner), pages.DEFAULT) == text


def test_teasers_marked_as_articles_are_not_the_article():
    teasers = "<section><h2>More</h2>" + "<article><h3>Other news</h3><p>Read this short teaser too.</p></article>" * 3 + "</section>"
    assert pages.extract(article_of(BODY * 3, after=teasers), pages.DEFAULT) == "\n".join([BODY_TEXT] * 3)
    wrapped = f"<body><main><article>{BODY * 3}</article>{teasers}</main></body>"
    assert pages.extract(wrapped, pages.DEFAULT) == "\n".join([BODY_TEXT] * 3)
    only_main = f"<body><main>{BODY * 3}{teasers}</main></body>"
    assert pages.extract(only_main, pages.DEFAULT).startswith("\n".join([BODY_TEXT] * 3))


@pytest.mark.parametrize("unit", ["<div>", "<p><button>", "<b>x", "<li>", "<td>y", "<ul><li>z", "</p><span>", "<article>"])
def test_unclosed_tags_take_linear_time(unit):
    import time

    start = time.time()
    pages.extract("<body><article>" + unit * 100_000 + BODY, pages.DEFAULT)
    assert time.time() - start < 15


def test_a_very_long_page():
    page = article_of(BODY * 40_000)  # 3 MB
    assert pages.extract(page, pages.DEFAULT) == "\n".join([BODY_TEXT] * 40_000)


def test_one_pass_gives_ids_and_counts_of_both_vocabularies(monkeypatch):
    """Also when pieces go through both generations of the cache."""
    monkeypatch.setattr(tokens, "BOTH_PIECES", 3)
    both = tokens.BothBpe(tokens.byte_bpe(), tokens.piece_bpe())
    for text in ("", "a", " a b", "one two  three one two", "x\n y \u00e9t\u00e9 \u2603 \u2603 <|endoftext|> z", "\u4e2d " * 9, "q" * 100 + " " + "q" * 100):
        for _ in range(2):
            assert both.measure(text) == (tokens.byte_bpe().packed(text), *tokens.piece_bpe().counts(text))
