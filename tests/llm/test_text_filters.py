"""op4, op5, op7, op8, op9, op10 and the pipeline on small cases."""

import itertools
import random
import zlib

import duckdb
import numpy as np
import pytest

from wattloom.llm import pii, vector_search
from wattloom.llm import toxicity as tox
from wattloom.llm.decontamination import contaminated
from wattloom.llm.html import extract_main_text, main_text, parse
from wattloom.llm.pii import replace_personal_data
from wattloom.llm.queries import ORACLES, QUERIES, RULES
from wattloom.llm.toxicity import toxicity
from wattloom.llm.url_templates import url_verdicts
from wattloom.llm.vector_search import top_k

TEXTS = [
    "Mail anna.b@example.com, ANNA.B@example.com or bob@example.com.",
    "Hosts 10.2.3.4 and 10.2.3.45; version 1.2.3 and 4.0 stay.",
    "Call +1 (974) 555-3436 or +1 (974) 5553436 now",
    'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" card 4785380592391139',
    "Mrs. Anna Berg met Mr. Ivan Petrov. Frau Berg and Господин stay; Mr. Иван Петров too.",
    "Nothing here", "", None, "10.2.3.4",
]


@pytest.fixture
def private(spark):
    return spark.createDataFrame([(k, t, "x") for k, t in enumerate(TEXTS)], "doc_id long, text string, kinds string")


def test_surrogates(private):
    out = {r.doc_id: r for r in replace_personal_data(private, "k").collect()}
    assert out[7].text is None and out[7].n_entities == 0 and out[6].text == "" and out[5].text == TEXTS[5]
    a, b, c = [w.strip(".,") for w in out[0].text.split() if "@" in w]
    assert a.lower() == b.lower() and a != c and a.split("@")[1] == c.split("@")[1] and a.endswith(".com") and b[:4].isupper()
    assert "10.2.3.4" not in out[1].text and "version 1.2.3 and 4.0 stay." in out[1].text
    assert out[8].text == out[1].text.split()[1]  # the same entity, the same surrogate
    first, second = out[2].text.removeprefix("Call ").removesuffix(" now").split(" or ")
    assert first.startswith("+1 (") and first.replace("-", "") == second and "555-3436" not in first
    token = out[3].text.split('"')[1]
    assert len(token) == 40 and set(token) <= set("0123456789abcdef") and token not in TEXTS[3]
    card = out[3].text.split()[-1]
    assert len(card) == 16 and card[0] == "4" and card.isdigit() and card != "4785380592391139"
    people = out[4].text
    assert people.startswith("Mrs. ") and "Anna" not in people and "Petrov" not in people and people.split()[1].endswith("a")
    assert "Иван" not in people and any("а" <= ch <= "я" for ch in people.split("Mr. ")[2])
    again = {r.doc_id: r.text for r in replace_personal_data(private, "k").collect()}
    assert again == {k: r.text for k, r in out.items()}
    assert out[0].text != {r.doc_id: r for r in replace_personal_data(private, "other").collect()}[0].text


def test_clashing_surrogates_are_drawn_again(spark, monkeypatch):
    monkeypatch.setattr(pii, "_address", lambda stream: pii.F.concat(pii.F.lit("9.9.9."), (pii._byte(stream, pii.F.lit(0)) % 40).cast("string")))
    docs = spark.createDataFrame([(k, f"at 1.1.1.{k} and 9.9.9.{k}") for k in range(12)], "doc_id long, text string")
    out = replace_personal_data(docs, "k").collect()
    found = [w for r in out for w in r.text.split() if "." in w]
    assert len(set(found)) == 24 and not {f"9.9.9.{k}" for k in range(12)} & set(found)
    assert replace_personal_data(docs.where("false"), "k").count() == 0


def test_pii_is_native(private):
    plan = replace_personal_data(private, "k")._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><script>var t="</p>";</script></head><body><header>Head</header>
<nav><ul><li><a href="/x">Menu</a></li></ul></nav><div class="ad">Buy</div><article><h1>A &amp;&amp; b</h1><p><b>First
 line<br><p>Second&nbsp;one <i>in</i>line<!-- no --></p><aside>Side</aside><form>Form</form><ul><li>x<li>y</ul></article>
<div class="comments"><p>Me too</p></div><footer>Foot</footer>"""


def test_main_text():
    assert main_text(parse(PAGE)) == "A && b\nFirst line\nSecond one inline\nx\ny"
    assert main_text(parse("")) == "" and main_text(parse("plain <p>one</p><p></p> two")) == "plain\none\ntwo"
    assert main_text(parse("<div><div hidden>no</div><td>a<td>b" + "<div>" * 3000 + "deep")) == "a\nb\ndeep"
    assert main_text(parse("<p>a < b</p><p>x</span></p></p>y")).startswith("a < b")


def test_sites_lose_what_repeats(spark):
    page = lambda k: f"<html><body><div class='top'><p>Welcome to our site</p></div><div class='text'><p>Story number {k} is new</p><p>It ends after {k * 7} words</p></div></body></html>"
    rows = [(k, f"http://a.example/{k}", page(k)) for k in range(20)] + [(100, "http://b.example/", page(1)), (101, None, None), (102, "http://a.example/x", "")]
    out = {r.page_id: r for r in extract_main_text(spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, low string")).collect()}
    assert out[3].text == "Story number 3 is new\nIt ends after 21 words" and out[3].n_chars == len(out[3].text)
    assert out[100].text.startswith("Welcome") and out[101].text == "" and out[101].n_chars == 0 and out[102].text == ""
    assert extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_toxicity_learns(spark):
    rnd = random.Random(1)
    words, bad = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("lon", "mer", "tis", "nov")], ["vilest", "scummy", "nasty"]
    rows, labels = [], []
    for k in range(900):
        toxic = k % 4 == 0
        text = [rnd.choice(words) for _ in range(rnd.randint(20, 60))]
        for _ in range(4 if toxic else 0):
            text[rnd.randrange(len(text))] = rnd.choice(bad)
        rows.append((k, " ".join(text)))
        labels.append((k, 1, int(toxic)))
    rows += [(5000, None), (5001, ""), (5002, "vilest scummy words " * 3000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, toxic int")
    out = {r.doc_id: r for r in toxicity(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    held = [k for k in range(900) if zlib.crc32(str(k).encode()) % 3 == 1]
    assert all(out[k].held_out == (k in set(held)) for k in range(900)) and len(out) == 903
    right = sum(out[k].predicted == (k % 4 == 0) for k in held)
    assert right >= 0.97 * len(held)
    text = dict(rows)
    spans = [text[0][s.start : s.end] for s in out[0].spans]
    assert spans and all(w in bad for s in spans for w in s.split())
    assert out[5000].predicted == 0 and out[5000].score == out[5001].score and out[5002].predicted == 1
    none = toxicity(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert none.where("predicted = 1").count() == 0 and toxicity(docs.where("false"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


def test_url_rules_and_templates(spark):
    rows = [(1, "http://A.Example.com/en/7"), (2, "https://example.com/en/8?x"), (3, "http://x.net/de/1#y"), (4, "http://example.net/de/8"), (5, None), (6, "no scheme"), (7, "http://notcom/en/"), (8, "http://b.org"), (9, "http://a.example.com/EN/7")]
    rows += [(100 + k, f"http://s.example.com/{'en' if k % 2 else 'xx'}/{k}") for k in range(40)]
    out = {r.page_id: r for r in url_verdicts(spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, host string"), RULES).collect()}
    assert len(out) == len(rows)
    got = {k: (out[k].host, out[k].path, out[k].rule, out[k].verdict) for k in range(1, 10)}
    assert got[1] == ("a.example.com", "/en/7", "example.com/en/7", "allow") and got[2] == ("example.com", "/en/8", "com/en/", "block")
    assert got[3] == ("x.net", "/de/1", "net/de/", "allow") and got[4] == ("example.net", "/de/8", "example.net/de/8", "block")
    assert got[5] == ("", "", None, "allow") and got[6] == ("", "", None, "allow") and got[7][2] is None and got[8][:2] == ("b.org", "") and got[9][2] is None
    assert out[101].rule == "com/en/" and out[100].template == "/xx/{num}" and out[100].verdict == "allow"
    assert url_verdicts(spark.createDataFrame([], "page_id long, url string"), RULES).count() == 0


def test_decontamination(spark):
    rnd = random.Random(4)
    words = [f"{a}{b}" for a in ("ban", "cor", "del", "fim", "gor", "hul", "jat") for b in ("", "er", "ing", "ol", "us")]
    noise = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    plain = "Every " + noise(30) + "."
    slots = "a farmer sells 12 apples to Anna and 7 pears to Boris then counts 12 kg left over"
    other = slots.replace("12", "95").replace("7", "31").replace("Anna", "Olga").replace("Boris", "Pavel").replace("kg", "lb")
    mixed = slots.replace("12 apples", "5 apples")
    bench = [(1, plain), (2, slots), (3, None), (4, ""), (5, "short one only")]
    rows = [(10, noise(50) + " " + plain.upper() + " " + noise(20)), (11, noise(9) + " " + slots), (12, other + " " + noise(9)), (13, mixed), (14, noise(500)), (15, None), (16, ""), (17, noise(5) + " short one only " + noise(5))]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, size int")
    items = spark.createDataFrame([(*r, 1) for r in bench], "item_id long, text string, key int")
    got = {(r.doc_id, r.item_id) for r in contaminated(docs, items).collect()}
    assert got == {(10, 1), (11, 2), (12, 2), (17, 5)}  # 13 gives one slot two values
    assert contaminated(docs.where("false"), items).count() == 0 and contaminated(docs, items.where("false")).count() == 0


def test_search_ties_nulls_and_widths(spark):
    rows = [(0, [0.5, 0.5]), (50, [1.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (100, [float("inf")]), (6, [-0.001, 2.0]), (7, []), (2, [0.1, 0.1])]
    got = top_k(spark.createDataFrame([(v, e, "b") for v, e in rows], "vec_id long, embedding array<float>, block string"), 3).collect()
    by = {(r.query_id, r.rank): (r.vec_id, r.score) for r in got}
    assert by[(0, 1)] == (6, 128 * -1 + 128 * 512) and by[(0, 2)] == (1, 32768) and by[(0, 3)] == (2, 32768)
    assert by[(50, 1)] == (0, 32768) and {q for q, _ in by} == {0, 50}
    assert top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_search_against_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = sorted(con.sql(ORACLES["op10_vector_search"]).fetchall())
    assert sorted(tuple(r) for r in QUERIES["op10_vector_search"](spark, sf).collect()) == want


@pytest.mark.parametrize("block, shard", [(7, 40), (1000, 1000)])
def test_shards_and_blocks_merge(spark, monkeypatch, block, shard):
    monkeypatch.setattr(vector_search, "QUERY_BLOCK", block)
    monkeypatch.setattr(vector_search, "SHARD", shard)
    rng = np.random.default_rng(4)
    rows = {k: (rng.integers(-3, 4, 12) / 8).tolist() for k in range(300)}  # few values, so many ties
    got = top_k(spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<float>"), 5, 5).collect()
    q = np.floor(256 * np.array(list(rows.values()))).astype(int)
    want = []
    for own in range(0, 300, 5):
        best = sorted((-int(q[own] @ q[k]), k) for k in rows if k != own)[:5]
        want += [(own, n, k, -s) for n, (s, k) in enumerate(best, 1)]
    assert sorted(tuple(r) for r in got) == want


def test_marginals_and_gradient_by_enumeration():
    rng = np.random.default_rng(0)
    chain = tox.Chain({"=a": 1, "=b": 2}, rng.normal(size=3), rng.normal(size=4), -0.7, np.array([[0.0, -1.1], [0.0, 0.4]]))
    docs = [rng.integers(0, 12, n).astype(np.int32) for n in (1, 2, 5, 7, 7)]

    def weight(codes, tags, words, shapes, start, moves):
        w = sum((words[c // 4] + shapes[c % 4]) * t for c, t in zip(codes, tags))
        return w + (start if tags[0] else 0) + sum(moves[a][b] for a, b in zip(tags, tags[1:]))

    args = (chain.words, chain.shapes, chain.start, chain.moves)
    for codes, p in zip(docs, tox.marginals(docs, chain), strict=True):
        all_tags = list(itertools.product((0, 1), repeat=len(codes)))
        w = np.exp([weight(codes, t, *args) for t in all_tags])
        np.testing.assert_allclose(p, (w[:, None] * np.array(all_tags)).sum(0) / w.sum(), atol=1e-10)

    # At its fit the penalised likelihood, by enumeration, is flat in every direction.
    tags = [rng.random(len(d)) < 0.4 for d in docs]
    fitted = tox._fit_chain(docs, tags, {"=a": 1, "=b": 2}, rounds=4000)

    def loss(x):
        total = -0.5 * (x**2).sum()
        for codes, truth in zip(docs, tags, strict=True):
            moves = [[0.0, x[-2]], [0.0, x[-1]]]
            every = [weight(codes, t, x[:3], x[3:7], x[7], moves) for t in itertools.product((0, 1), repeat=len(codes))]
            total += weight(codes, [int(t) for t in truth], x[:3], x[3:7], x[7], moves) - np.log(np.exp(every).sum())
        return total

    at = np.concatenate([fitted.words, fitted.shapes, [fitted.start], fitted.moves[:, 1]])
    slope = [(loss(at + 1e-4 * e) - loss(at - 1e-4 * e)) / 2e-4 for e in np.eye(len(at))]
    assert np.abs(slope).max() < 0.05


STAGE_ROWS = [(1, "a b c d e f g", "en"), (1, "a b c d e f g", "en"), (2, None, "en"), (3, "", None), (None, "other words that nobody else has written so far", "de"), (None, None, None), (4, "mail to x@y.org or 10.1.2.3 now please", "en")]


@pytest.mark.parametrize("rows", [STAGE_ROWS, []])
def test_pipeline_stages_on_odd_rows(spark, tmp_path, rows):
    """Nulls, repeated rows, empty tables, and columns named as the operators' own."""
    import corpus_pipeline as c

    schema = "doc_id long, text string, lang string, n_chars long, score double, kept boolean, kinds string, draw long, part string, rank int"
    docs = spark.createDataFrame([(d, t, k, len(t or ""), 0.9, False, "x", 1, "p", 1) for d, t, k in rows], schema)
    sf = str(tmp_path)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    out = docs
    for name, stage in c.STAGES[:-1]:
        out = c.materialize(stage(spark, out, sf), name)
        assert out.columns == docs.columns
    got = out.collect()
    assert len(got) == len(rows) and {r.doc_id for r in got} == {d for d, _, _ in rows}
    assert not any(r.text and ("x@y.org" in r.text or "10.1.2.3" in r.text) for r in got)
    packed = c.STAGES[-1][1](spark, out, sf)
    assert packed.groupBy().sum("length").first()[0] == (None if not rows else sum(r.doc_tokens for r in packed.where("start = 0").collect()))


def test_pipeline_by_stage(spark, sf):
    """Each stage's decisions against a plain restatement of them."""
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out, kept = docs, {}
    for name, stage in c.STAGES[:-1]:
        out = c.materialize(stage(spark, out, sf), name)
        kept[name] = {r.doc_id: r.text for r in out.collect()}
        assert out.columns == docs.columns
    words = lambda t: (t or "").encode().lower().split()
    sets = {d: frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for d, w in ((d, words(t)) for d, t in kept["near_dedup"].items()) if w}
    ids = sorted(sets)
    assert not [1 for i, a in enumerate(ids) for b in ids[:i] if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert set(kept["near_dedup"]) <= set(kept["toxicity"]) and set(kept["personal_data"]) == set(kept["decontamination"])
    items = [" ".join("".join(ch for ch in w if ch.isalnum()).lower() for w in r.text.split()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    plain = {d: " ".join(x for x in ("".join(ch for ch in w if ch.isalnum()).lower() for w in t.split()) if x) for d, t in kept["near_dedup"].items()}
    assert {d for d, t in plain.items() if not any(i and i in t for i in items)} == set(kept["decontamination"])
    packed = c.STAGES[-1][1](spark, out, sf).toPandas()
    assert set(packed.doc_id) == set(kept["personal_data"]) and packed.groupby("sequence_id")["length"].sum().max() <= 4096


def test_decontamination_of_items_with_few_words(spark):
    names = "Anna Berg met Carl Dorn and Ella Frey near Gera Hof with Ida Jahn then Karl Lenz"
    bench = [(1, "Compute 12 + 45 * 3 - 7 / 2"), (2, "1 2 3 5 8 13 21 34 55 89 144 233"), (3, names)]
    rows = [(1, "so compute 12 + 45 * 3 - 7 / 2 now"), (2, "x 1 2 3 5 8 13 21 34 55 89 144 233 y"), (3, names.upper()), (4, "and " + names.lower()), (5, "so compute 12 + 45 * 3 - 8 / 2 now"), (6, "1 2 3 5 8 13 21"), (7, "34 55 89")]
    docs, items = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in contaminated(docs, items).collect()} == {(1, 1), (2, 2), (3, 3), (4, 3)}
