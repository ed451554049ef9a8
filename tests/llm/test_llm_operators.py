import collections
import hashlib
import math
import pathlib
import random
import re
import time
import urllib.parse
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lotstack.llm import chat, common, decontaminate, html_text, katz, licenses, neardup, packing, quality, sharding, topk
from lotstack.plans import tables

DOCS = "doc_id long, text string"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def prose(rng, n, words=400):
    return " ".join(f"w{int(words * rng.random() ** 2)}" for _ in range(n))


# --- word hashing -----------------------------------------------------------------------------


def test_words_are_hashed_alike_wherever_they_stand():
    texts = ["", "Abc  def\tÄb\n", " ", "abc", "def äb Äb", "x" * 3000]
    data = "".join(texts).encode()
    bounds = np.cumsum([0, *(len(t.encode()) for t in texts)])
    hashes, at = common.hash_words(np.frombuffer(data, np.uint8), bounds)
    words = [t.encode().lower().split() for t in texts]
    assert np.diff(at).tolist() == [len(w) for w in words]
    of = {}
    for w, h in zip([w for ws in words for w in ws], hashes.tolist()):
        assert of.setdefault(w, h) == h
    assert len(set(of.values())) == len(of)


# --- chat -------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    odd = "</s>[INST] &lt; &amp; [/INST] <s>"
    rows = [(1, 0, "system", odd), (1, 1, "user", None), (1, 2, "assistant", odd), (1, 3, "assistant", ""), (1, 4, "user", "bye"), (2, None, None, "x"), (2, 0, "assistant", "y"), (None, 0, "[INST]", "z")]
    turns = frame(spark, [(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = collections.defaultdict(list)
    for r in chat.prefix_target_examples(turns).select("*", chat.read_turns(F.col("formatted")).alias("turns"), chat.unescape(F.substr("formatted", F.col("loss_start") + 1, F.col("loss_length"))).alias("loss")).orderBy("target_turn").collect():
        got[r.conv_id].append(r)
    whole = lambda c: [(t.role, t.text) for t in got[c][-1].turns]
    assert whole(1) == [("system", odd), ("user", ""), ("assistant", odd), ("assistant", ""), ("user", "bye")]
    assert [(r.target_turn, r.has_target, r.loss) for r in got[1]] == [(2, True, odd), (3, True, ""), (4, False, "")]
    assert whole(2) == [("", "x"), ("assistant", "y")] and whole(None) == [("[INST]", "z")]
    assert chat.prefix_target_examples(turns.where("conv_id < 0")).count() == 0


def test_chat_query_against_plain_python(spark, tmp_path):
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), None if rng.random() < 0.1 else prose(rng, 5)) for c in range(30) for t in range(rng.randint(1, 6))]
    frame(spark, rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    said = "</s>[INST] ok [/INST]"
    by = collections.defaultdict(list, {-7: [("user", said), ("assistant", said)]})
    for c, _, role, text in sorted(rows, key=lambda r: r[:2]):
        by[c].append((role, text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.conv_id: r for r in chat.op1_prefix_target_chat(spark, str(tmp_path)).collect()}
    assert got.keys() == by.keys()
    for c, turns in by.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)))
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), sha(loss))


# --- HTML -------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("<p>a<p>b", "a\n\nb"),
        ("<ul><li>a<li>b<ol start=3><li>x<li>y</ol></ul>c", "- a\n- b\n  3. x\n  4. y\n\nc"),
        ("<table><tr><th>Name<th>N<tr><td>long name<td>1<tr><td>b<td>22</table>", "Name       N\nlong name  1\nb          22"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"),
        ("x <script>if (a<b) {}</script><style>p{}</style><!-- n -->y", "x y"),
        ("<div style='Display: None'>no</div><div hidden>no</div><span style='visibility:hidden'>no</span>yes", "yes"),
        ("a &lt;b&gt; &amp; &eacute; < 5", "a <b> & é < 5"),
        ("<pre> a\n  b</pre>", " a\n  b"),
        ("<head><title>t</title></head><body>b</i></div></body>", "b"),
        ("one<br>two<div>three</div>four", "one\ntwo\nthree\nfour"),
        ("<b>bo</b>ld  \n <i> it</i>", "bold it"),
        ("<a <b", "<a <b"),
        ("<p title='x>one<p>two", "one\n\ntwo"),
        ("<select><option>1<option>2</select>", "1\n2"),
    ],
)
def test_html_rendering(html, text):
    assert html_text.render(html) == text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("a <svg><defs/><title>no</title><defs><text>no</text></defs><path d='M0'/><text>North</text><text>South</text></svg> b", "a North South b"),
        ("<svg><style/><metadata>no</metadata><g><text>x<tspan>y</tspan></text></g></svg>z", "xy z"),
        ("<p>so <math><semantics><mrow><mi>a</mi><mo>=</mo><mn>2</mn></mrow><annotation>no</annotation></semantics></math> holds", "so a=2 holds"),
        ("<head><title>no</title>\n bare text<p>more", "bare text\n\nmore"),
        ("<head><meta charset=x>&lt;x", "<x"),
        ("<defs>yes</defs><desc>too</desc>", "yestoo"),
    ],
)
def test_html_shows_drawn_text_and_text_after_an_open_head(html, text):
    assert html_text.render(html) == text


def test_html_survives_deep_and_long_pages():
    assert html_text.render("<div>" * 50_000 + "x") == "x"
    assert html_text.render("<p>" + "word " * 200_000).count("word") == 200_000
    assert html_text.render("<table><tr><td>" * 2000 + "x").strip() == "x"
    assert html_text.render("<a '" * 50_000).startswith("<a '") and html_text.render("<a '" * 50_000 + ">x") == "x"


def test_html_loses_no_visible_words(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in html_text.extract(pages.withColumn("text", F.lit("clash"))).collect()}
    for r in pages.collect():
        bare = re.sub(r"(?s)<!--.*?-->|<head>.*?</head>|<(script|style)\b.*?</\1>", " ", r.html)
        bare = re.sub(r'(?s)<(\w+)[^>]*(?:display:\s*none|\bhidden\b)[^>]*>.*?</\1>', " ", bare)
        words = lambda s: re.findall(r"\w{6,}", s)
        import html as h

        missing = set(words(h.unescape(re.sub(r"<[^>]*>", " ", bare)))) - set(words(got[r.page_id]))
        assert not missing, (r.page_id, list(missing)[:5])
    assert html_text.extract(pages.where("page_id < 0")).count() == 0


def test_html_of_hostile_pages():
    digits = "9" * 5000
    cell = html_text.render(f"<table><tr><td colspan={digits} rowspan=0{digits}>a<td>b</table><ol start={digits}><li>c</ol>&#{digits}; &#x{digits}; &#{'0' * 5000}65; &#65;&#x41")
    assert "a" in cell and cell.endswith("\ufffd \ufffd A AA")
    for page in ("</a ", "<!", "<?", "<a ", '</a "', "<p><button>" + "<b>" * 3000 + "<div>", "<td>", "<table><tr>", "<!--"):
        took = []
        for n in (1, 8):
            began = time.process_time()
            html_text.render(("x " + page * 4000 * n) if len(page) < 15 else page.replace("<b>" * 3000, "<b>" * 3000 * n) + "<div>" * 3000 * n)
            took.append(time.process_time() - began)
        assert took[1] < 24 * max(took[0], 0.05), (page, took)
    assert html_text.render("a<b>b</b> c < d <e") == "ab c < d <e" and html_text.render("a<!--b") == "a"


# --- top-k ------------------------------------------------------------------------------------


def brute_topk(rows, k=5):
    out = []
    for at, (q, v) in enumerate(rows):
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for other, (i, w) in enumerate(rows) if other != at)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    return out


@pytest.mark.parametrize("levels", [2, 400])
def test_topk_equals_brute_force(spark, levels, monkeypatch):
    rng = np.random.default_rng(levels)
    vectors = {i: (rng.integers(-levels, levels + 1, 8) / 256).tolist() for i in range(300)}
    bad = [(1000, None), (1050, [0.5, None] + [0.0] * 6), (1100, [float("nan")] + [0.0] * 7), (1150, [float("inf")] + [0.0] * 7), (None, [0.1] * 8)]
    again = [(7, vectors[7]), (50, vectors[50])]  # rows with equal ids are rows like others
    table = frame(spark, [*vectors.items(), *bad, *again], "vec_id long, embedding array<float>")
    monkeypatch.setattr(topk, "CANDIDATES_IN_BLOCK", 64)
    got = topk.top_k(topk.quantised(table), F.col("vec_id") % 50 == 0, 5).collect()
    whole = [(i, [math.floor(256 * np.float32(x)) for x in v]) for i, v in [*vectors.items(), *again]]
    assert sorted(tuple(r) for r in got) == sorted(brute_topk(whole))


def test_topk_sends_no_queries_through_the_driver(spark, monkeypatch):
    rng = np.random.default_rng(3)
    table = frame(spark, [(i, rng.normal(0, 1, 4).tolist()) for i in range(400)], "vec_id long, embedding array<float>")
    monkeypatch.setattr(topk, "CANDIDATES_IN_BLOCK", 16)
    found = topk.top_k(topk.quantised(table), F.col("vec_id") % 50 == 0, 5)
    assert found.count() == 40
    found.collect()
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_topk_blocks_grow_once_there_are_many(spark, monkeypatch):
    vectors = {i: [float(i % 7) / 256, float(i % 11) / 256] for i in range(400)}
    for name, value in (("CANDIDATES_IN_BLOCK", 16), ("FEW_BLOCKS", 3), ("CANDIDATES_IN_LARGE_BLOCK", 300)):
        monkeypatch.setattr(topk, name, value)
    got = topk.top_k(topk.quantised(frame(spark, [*vectors.items()], "vec_id long, embedding array<double>")), F.col("vec_id") % 50 == 0, 5).collect()
    assert sorted(tuple(r) for r in got) == sorted(brute_topk([(i, [i % 7, i % 11]) for i in vectors]))


def test_topk_of_few_and_none(spark):
    table = frame(spark, [(0, [1.0, 2.0]), (3, [1.0]), (4, [])], "vec_id long, embedding array<float>")
    got = topk.top_k(topk.quantised(table), F.col("vec_id") == 0, 5).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(3, 65536), (4, 0)]
    assert topk.top_k(topk.quantised(table.where("vec_id < 0")), F.col("vec_id") == 0, 5).count() == 0


def test_topk_of_large_components(spark):
    vectors = [(0, [1.0, 1.0]), (1, [1e6, 0.0]), (2, [2e5, 0.0]), (50, [2.0**26, 3.0]), (3, [3.0, -1.0])]
    got = topk.top_k(topk.quantised(frame(spark, vectors, "vec_id long, embedding array<double>")), F.col("vec_id") % 50 == 0, 5).collect()
    assert sorted(tuple(r) for r in got) == sorted(brute_topk([(i, [math.floor(256 * x) for x in v]) for i, v in vectors]))
    beyond = frame(spark, [(0, [1e30]), (1, [1e30])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="(?i)too large|overflow|int"):
        topk.top_k(topk.quantised(beyond), F.col("vec_id") == 0, 5).collect()


def test_threshold_stops_early():
    rng = np.random.default_rng(0)
    rows = rng.integers(-5, 6, (4000, 3)).astype(float)
    rows[17] = 900
    order = np.argsort(-rows, axis=0, kind="stable").T
    ranked = np.take_along_axis(rows.T, order, axis=1)
    reads = []

    class Watched(np.ndarray):
        def __getitem__(self, key):
            out = super().__getitem__(key)
            reads.append(getattr(out, "size", 1))
            return out

    ids, scores = topk.threshold_topk(np.array([1.0, 2.0, 3.0]), -1, np.arange(4000), rows, order.view(Watched), ranked, 1)
    assert ids[0] == 17 and scores[0] == 5400 and sum(reads) < 200


# --- licences ---------------------------------------------------------------------------------


def test_license_places(spark):
    texts = [None, "", "CC  BY-NC 4.0. cc by", "Licensed under the Apache License, Version 2.0.", "the GNU General Public License, and general public library", "ALL rights reserved all rights reserved", "general general public license" + " public license" * 500, "Released under the MIT License.", "mit license"]
    docs = frame(spark, list(enumerate(texts)) + [(1, "")]).withColumn("places", F.lit(1))
    found = licenses.scan(docs.drop("places"), licenses.document_frequencies(docs))
    got = {r.doc_id: r for r in found.collect()}
    base = lambda k: sorted((p.start, p.label) for p in got[k].places if p.base)
    assert [base(k) for k in range(9)] == [[], [], [(0, "cc-by"), (5, "cc-by")], [], [(2, "gpl")], [(0, "reserved"), (3, "reserved")], [(1, "gpl")], [], []]
    labels = lambda k: {p.label for p in got[k].places}
    assert "apache-2.0" in labels(3) and "mit" in labels(7) and labels(8) == set()
    assert got[0].n_words == 0 and got[2].n_words == 7
    assert licenses.scan(docs.where("doc_id < 0"), {}).count() == 0


def plain_places(text, frequencies):
    """Every place of every entry, by trying all starts: index words, key phrases and share as the method asks."""
    words = [w for w in re.split(r"[\x00-/:-`{-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    out = set()
    for k, (label, own, spans, base) in enumerate(licenses._entries()):
        rare = sorted(set(own), key=lambda w: (frequencies.get(w, 0), w))[: 1 if base else licenses.RARE_WORDS]
        index = [own.index(w) for w in rare]
        stands = lambda start, j: 0 <= start + j < len(words) and words[start + j] == own[j]  # noqa: B023, E731
        for start in range(-len(own), len(words)):
            share = sum(stands(start, j) for j in range(len(own))) / len(own)
            together = sum(stands(start, j) for j in index) >= min(len(index), licenses.RARE_MATCHES)
            if together and all(stands(start, j) for a, n in spans for j in range(a, a + n)) and share >= licenses.LEAST_SHARE:
                out.add((k, start, label, base, round(share, 9)))
    return out


def test_license_scans_equal_a_walk_over_all_places(spark):
    rng = random.Random(8)
    notices = [text for _, text, _ in licenses.TEMPLATES]
    texts = [None, "", "mit license " * 30, " ".join(p for p in licenses.BASE_PHRASES)]
    for k in range(120):
        words = rng.choice(notices).split()
        if k % 3:  # some words lost, changed or put in
            for _ in range(rng.randrange(1, 6)):
                at = rng.randrange(len(words))
                words[at : at + rng.choice([0, 1, 1])] = rng.choice([[], ["other"], [words[at]]]) if len(words) > 3 else words[at : at + 1]
        around = [rng.choice(["the", "license", "software", "general", "public", "copy"]) for _ in range(rng.randrange(9))]
        texts.append(rng.choice([" ", ", ", ".\n# "]).join([*around, *(w.upper() if rng.random() < 0.2 else w for w in words), *around[:3]]))
    docs = frame(spark, list(enumerate(texts)))
    frequencies = licenses.document_frequencies(docs)
    got = {r.doc_id: {(p.entry, p.start, p.label, p.base, round(p.share, 9)) for p in r.places} for r in licenses.scan(docs, frequencies).collect()}
    assert got == {k: plain_places(t, frequencies) for k, t in enumerate(texts)}
    assert {p[2] for places in got.values() for p in places} >= {"mit", "isc", "bsd-2-clause", "bsd-3-clause", "apache-2.0", "gpl-2.0", "gpl-3.0", "mpl-2.0", "cc-by-4.0"}


# --- near duplicates --------------------------------------------------------------------------


def plain_sets(texts):
    def of(text):
        w = (text or "").encode().lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    return {k: of(t) for k, t in texts.items()}


def plain_components(sets, percent):
    ids = sorted(sets)
    label = {i: i for i in ids}
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_equal_brute_force(spark, percent):
    rng = random.Random(percent)
    texts, k = {}, 0
    shared = prose(rng, 60)
    for _ in range(12):
        words = prose(rng, rng.choice([3, 12, 80, 300, 900])).split()
        for _ in range(rng.randint(1, 14)):
            own = list(words)
            for _ in range(rng.randint(0, max(1, len(own) // 45))):
                own[rng.randrange(len(own))] = f"x{rng.random()}"
            texts[k] = " ".join(own) if rng.random() < 0.7 else shared + " " + " ".join(own)
            k += 1
    texts |= {k: None, k + 1: "", k + 2: " \n", k + 3: "Two WORDS", k + 4: "two words"}
    rows = [(i, t, "x") for i, t in texts.items()]
    rng.shuffle(rows)
    got = {r.doc_id: r for r in neardup.near_duplicates(frame(spark, rows, DOCS + ", rep string"), percent).collect()}
    sets = plain_sets(texts)
    want = plain_components(sets, percent)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.n_shingles == len(sets[i]) and r.kept == (want[i] == i) for i, r in got.items())


def test_near_duplicates_of_odd_tables(spark):
    assert neardup.near_duplicates(frame(spark, [])).count() == 0
    got = neardup.near_duplicates(frame(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f")])).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got) == [("1", "1", True), ("1", "1", True), ("2", "1", False), ("None", "None", True)]


# --- Katz -------------------------------------------------------------------------------------


def plain_katz(texts, held):
    tokens = {i: (t or "").encode().lower().split() + [None] for i, t in texts.items()}
    c = collections.Counter(w for i, ws in tokens.items() if i not in held for w in ws)
    n = sum(c.values())

    def discount(of, first):
        return {r: ((r + 1) * of[r + 1] / (r * of[r]) if of[r] and 0 < (r + 1) * of[r + 1] < r * of[r] else 1.0) for r in range(first, katz.DISCOUNTED + 1)}

    d = discount(collections.Counter(c.values()), 1)
    left = 1 - sum(d.get(x, 1.0) * x for x in c.values()) / n
    whole = n if left > 1e-12 else n + 1
    p = {w: d.get(x, 1.0) * x / whole for w, x in c.items()}
    unknown = left if left > 1e-12 else 1 / (n + 1)
    pairs, before = collections.Counter(), collections.Counter()
    for i, ws in tokens.items():
        if i not in held:
            for h, w in zip([0, *ws], ws):
                pairs[h, w] += 1
                before[h] += 1
    kept = {k: x for k, x in pairs.items() if x >= katz.MIN_COUNT}
    d = discount(collections.Counter(kept.values()), katz.MIN_COUNT)
    after = collections.defaultdict(dict)
    for (h, w), x in kept.items():
        after[h][w] = d.get(x, 1.0) * x / before[h]
    alpha = {}
    for h, own in after.items():
        total = sum(own.values())
        if total > 1 - 1e-9:
            for w in own:
                own[w] *= before[h] / (before[h] + 1) / total
        alpha[h] = (1 - sum(own.values())) / (1 - sum(p[w] for w in own))
        assert math.isclose(sum(own.values()) + alpha[h] * (1 - sum(p[w] for w in own)), 1.0)
    assert math.isclose(sum(p.values()) + unknown, 1.0)
    score = lambda ws: sum(math.log10(after[h][w] if w in after.get(h, {}) else alpha.get(h, 1.0) * p.get(w, unknown)) for h, w in zip([0, *ws], ws))
    base = lambda ws: sum(math.log10((c[w] + 0.1) / (n + 0.1 * (len(c) + 1))) for w in ws)
    return {i: (len(ws), sum(c[w] > 0 for w in ws), n, base(ws), score(ws)) for i, ws in tokens.items()}


@pytest.mark.parametrize("most", [1 << 20, 40])
def test_katz_equals_plain_python(spark, most):
    rng = random.Random(9)
    texts = {i: prose(rng, rng.randint(0, 60), 90) for i in range(80)} | {80: None, 81: "", 82: "Only Here"}
    held = {i for i in texts if zlib.crc32(str(i).encode()) % 10 == 0}
    rows = [(i, t, "x") for i, t in texts.items()]
    docs = frame(spark, rows, DOCS + ", score string").drop("score")
    got = katz.katz_scores(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, most).collect()
    want = plain_katz(texts, held)
    assert len(got) == len(texts)
    for r in got:
        assert r.held_out == (r.doc_id in held)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == pytest.approx(want[r.doc_id], abs=1e-7)


def plain_katz_of_order(texts, held, order):
    """Scores by the recursive definition, over tuples of words."""
    tokens = {i: ["<s>", *(t or "").lower().split(), None] for i, t in texts.items()}
    counts = {n: collections.Counter(tuple(ws[k - n + 1 : k + 1]) for i, ws in tokens.items() if i not in held for k in range(1, len(ws)) if k - n + 1 >= 0) for n in range(1, order + 1)}
    d, after, before, alpha = {}, collections.defaultdict(list), collections.Counter(), {}
    for n, of_n in counts.items():
        of = collections.Counter(of_n.values())
        d[n] = {r: ((r + 1) * of[r + 1] / (r * of[r]) if of[r] and 0 < (r + 1) * of[r + 1] < r * of[r] else 1.0) for r in range(1, 6)}
        for gram, c in of_n.items():
            after[gram[:-1]].append(gram)
            before[gram[:-1]] += c

    def own(gram):
        n, h = len(gram), gram[:-1]
        total = sum(d[n].get(counts[n][g], 1.0) * counts[n][g] for g in after[h])
        p = d[n].get(counts[n][gram], 1.0) * counts[n][gram] / before[h]
        return p if total / before[h] <= 1 - 1e-9 else p * before[h] / (before[h] + 1) / (total / before[h])

    def probability(gram):
        n, h = len(gram), gram[:-1]
        if counts[n][gram]:
            return own(gram)
        if n == 1:
            return 1 - sum(own(g) for g in after[()])
        if h in after and h not in alpha:
            alpha[h] = (1 - sum(own(g) for g in after[h])) / (1 - sum(probability(g[1:]) for g in after[h]))
        return alpha.get(h, 1.0) * probability(gram[1:])

    return {i: sum(math.log10(probability(tuple(ws[max(0, k - order + 1) : k + 1]))) for k in range(1, len(ws))) for i, ws in tokens.items()}


@pytest.mark.parametrize("order", [2, 3, 4])
def test_katz_keeps_what_was_seen_once_in_each_order(spark, order):
    rng = random.Random(5)
    texts = {i: prose(rng, rng.randint(0, 50), 12) for i in range(60)} | {60: None, 61: "", 62: "Only Here", 63: "w1"}
    held = {i for i in texts if i % 5 == 0}
    got = katz.katz_scores(frame(spark, list(texts.items())), F.col("doc_id") % 5 == 0, 30, order).collect()
    assert {r.doc_id: r.score for r in got} == pytest.approx(plain_katz_of_order(texts, held, order), abs=1e-7)
    assert katz.MIN_COUNT == 1 and katz.ORDER == 3


def test_katz_counts_more_ngrams_of_a_text_than_one_row_holds(spark):
    texts = {1: " ".join(f"w{i}" for i in range(40_000)), 2: "w1 w2 w3 w9 w8", 5: "w1 w2 w3 w4 w7 w7"}
    got = katz.katz_scores(frame(spark, list(texts.items())), F.col("doc_id") == 5, 30, 3).collect()
    want = plain_katz_of_order(texts, {5}, 3)
    assert {r.doc_id: r.score for r in got} == pytest.approx(want, rel=1e-10)


def test_katz_tables_stay_small_beside_the_texts(spark, monkeypatch):
    rng = random.Random(3)
    texts = [(i, " ".join(f"w{int(rng.paretovariate(0.3)) % 5000}" for _ in range(300))) for i in range(600)]
    kept = []

    def materialize(df, name):
        out = tables.materialize(df, name)
        kept.append((out, sum(pathlib.Path(urllib.parse.urlparse(f).path).stat().st_size for f in out.inputFiles())))
        return out

    monkeypatch.setattr(katz, "materialize", materialize)
    katz.katz_scores(frame(spark, texts), F.col("doc_id") % 10 == 0, order=3).collect()
    size = sum(len(t) for _, t in texts)
    assert sum(n for _, n in kept) < 5 * size


def test_katz_of_odd_tables(spark):
    assert katz.katz_scores(frame(spark, []), F.lit(False)).count() == 0
    only = katz.katz_scores(frame(spark, [(1, "a b")]), F.lit(True)).first()
    assert (only.n_tokens, only.n_known, only.train_tokens) == (3, 0, 0) and math.isfinite(only.score)


# --- decontamination --------------------------------------------------------------------------


def test_decontamination_finds_copies_with_substitutions(spark):
    rng = random.Random(4)
    item = prose(rng, 40, 5000).split()
    swapped = [f"z{k}" if k % 9 == 4 else w for k, w in enumerate(item)]
    inserted = item[:20] + ["new", "words"] + item[20:]
    bench = frame(spark, [(1, " ".join(item)), (2, "one two three four five six"), (3, "a b"), (4, None), (5, "")], "item_id long, text string")
    around = lambda words: " ".join([prose(rng, 50, 5000), *words, prose(rng, 50, 5000)])
    texts = [around(item), around(swapped), around(inserted), around([]), around(item[:10]), "x ONE two three four five six", "a b", None, "", " ".join(item)]
    docs = frame(spark, [(k, t, 0.5) for k, t in enumerate(texts)], DOCS + ", covered double")
    got = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(docs, bench).collect()}
    assert got == {(0, 1), (1, 1), (2, 1), (5, 2), (9, 1)}
    kept = decontaminate.decontaminated(docs, bench)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 6, 7, 8] and kept.columns == docs.columns
    assert decontaminate.overlaps(docs, bench.where("item_id < 0")).count() == 0 and decontaminate.overlaps(docs.where("doc_id < 0"), bench).count() == 0


def test_decontamination_finds_long_quotes_and_short_items(spark):
    rng = random.Random(11)
    long = [f"v{k}" for k in range(500)]
    bench = frame(spark, [(1, " ".join(long)), (2, "one two three four five six"), (3, "who wrote the first novel")], "item_id long, text string")
    around = lambda words: " ".join([prose(rng, 50, 5000), *words, prose(rng, 50, 5000)])
    texts = [around(long[100:300]), around(long[7:20]), around(long[7:19])]
    texts += [around(t.split()) for t in ("one two three 4 five six", 'One two, "three" four five six.', "(one two three four five seven", "one two 3 4 five six", "“Who wrote the first – novel”?", "who wrote the novel first")]
    got = {(r.doc_id, r.item_id): round(r.covered, 3) for r in decontaminate.overlaps(frame(spark, list(enumerate(texts))), bench).collect()}
    assert got == {(0, 1): 0.4, (1, 1): 0.026, (3, 2): 0.833, (4, 2): 1.0, (5, 2): 0.833, (7, 3): 1.0}


def test_decontamination_in_blocks(spark, monkeypatch):
    rng = random.Random(8)
    items = [(k, prose(rng, 30, 5000)) for k in range(12)]
    docs = frame(spark, [(k, prose(rng, 20, 5000) + " " + t) for k, t in items])
    monkeypatch.setattr(decontaminate, "BLOCK_TOKENS", 100)
    got = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(docs, frame(spark, items, "item_id long, text string")).collect()}
    assert got == {(k, k) for k, _ in items}


def plain_overlaps(texts, items):
    """Every place of every item against every text, word by word; items have 12 words or more."""
    out = {}
    for t, text in texts.items():
        ws = (text or "").lower().split()
        for i, item in items.items():
            own = item.lower().split()
            any_place, most = set(), 0
            for start in range(-len(own) + 1, len(ws)):
                equal = [0 <= start + k < len(ws) and ws[start + k] == w for k, w in enumerate(own)]
                if not any(all(0 <= start + b + k < len(ws) and equal[b + k] for k, bit in enumerate(m) if bit == "1") for m in decontaminate.MASKS for b in range(len(own) - 11)):
                    continue
                good = {b + k for b in range(len(own) - 11) if sum(equal[b : b + 12]) >= 8 for k in range(12)}
                met = {k for k in good if equal[k]}
                any_place |= met
                most = max(most, len(met))
            if 2 * len(any_place) >= len(own) or most >= 13:
                out[t, i] = len(any_place) / len(own)
    return out


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(19)
    items = {f"item-{k}": prose(rng, rng.randint(12, 45), 9) if k % 2 else prose(rng, rng.randint(12, 45), 3000) for k in range(14)}
    texts = {}
    for k in range(60):
        ws = rng.choice(list(items.values())).split()
        a = rng.randint(0, len(ws) - 6)
        part = [w if rng.random() > 0.12 else "other" for w in ws[a : a + rng.randint(6, 45)]]
        texts[k] = " ".join([prose(rng, rng.randint(0, 9), 9), *part * rng.choice([1, 1, 3]), prose(rng, rng.randint(0, 9), 3000)])
    got = decontaminate.overlaps(frame(spark, list(texts.items())), frame(spark, list(items.items()), "item_id string, text string")).collect()
    want = plain_overlaps(texts, items)
    assert len(want) > 20 and {(r.doc_id, r.item_id): r.covered for r in got} == pytest.approx(want)


def test_decontamination_of_a_passage_that_all_items_and_texts_repeat():
    shared = [f"s{k}" for k in range(14)]
    index = decontaminate.Index([(k, " ".join([f"own{k}", *shared, f"end{k}"])) for k in range(600)])
    data = np.frombuffer(" ".join(shared * 600).encode(), np.uint8)
    began = time.process_time()
    found = index.search(data, np.array([0, len(data)]))
    assert len(found) == 600 and set(found.values()) == {14 / 16} and time.process_time() - began < 6


# --- packing ----------------------------------------------------------------------------------


def test_encoder_equals_the_tokenizer():
    plain, own = Tokenizer.from_file(TOKENIZER), packing.Encoder(TOKENIZER)
    rng = random.Random(2)
    letters = [chr(c) for c in range(0x180)] + list("   \n\n\t'sdlmtreve") * 8
    texts = ["", "it's  they'll\n\n x", "<|endoftext|> a", "日本 語", "a b٠"] + ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(3000)]
    for t, e in zip(texts, plain.encode_batch(texts, add_special_tokens=False)):
        assert own.encode(t) == np.array(e.ids, "<u4").tobytes(), t


def check_packing(rows, capacity):
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for placed in by.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("seed", range(6))
def test_plans_fill_sequences(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([rng.randint(1, 100), rng.randint(20, 60), rng.randint(34, 100), 50]) for _ in range(rng.choice([1, 7, 400]))]
    placed = packing.plan(collections.Counter(sizes), 100)
    got = collections.Counter()
    used = collections.defaultdict(int)
    for size, first, end, sequence, offset in placed:
        assert first == got[size]
        got[size] += end - first
        for k in range(end - first):
            used[sequence + k] += size
    assert got == collections.Counter(sizes) and max(used.values()) <= 100
    large = sum(3 * s > 100 for s in sizes)
    assert len(used) <= max(math.ceil(sum(sizes) / 100) * 1.25 + 1, large)
    # large pieces alone: at most two to a sequence, as many pairs as there can be
    big = sorted(s for s in sizes if 3 * s > 100)
    pairs, i, j = 0, 0, len(big) - 1
    while i < j:
        if big[i] + big[j] <= 100:
            pairs, i = pairs + 1, i + 1
        j -= 1
    own = packing.plan(collections.Counter(big), 100)
    assert sum(e - f for _, f, e, _, o in own if o == 0) == len(big) - pairs


def test_packing_whole_texts(spark):
    rng = random.Random(1)
    texts = {k: prose(rng, rng.choice([1, 5, 40, 900])) for k in range(60)} | {60: None, 61: "", 62: "word " * 5000}
    docs = frame(spark, [(k, t, 1) for k, t in texts.items()] + [(None, "n", 1), (3, texts[3], 1)], DOCS + ", length int")
    pieces = common.materialize(packing.token_pieces(docs, TOKENIZER, 256, keep_ids=True), "pieces")
    rows = packing.pack(pieces, 256).collect()
    check_packing(rows, 256)
    plain = Tokenizer.from_file(TOKENIZER)
    ids = {k: [*plain.encode(t or "", add_special_tokens=False).ids, 0] for k, t in texts.items()}
    for r in rows:
        if r.doc_id is not None:
            own = ids[r.doc_id][r.start : r.start + r.length]
            assert r.ids == own and r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes()) and (r.piece == 0 or r.length == 256)
    assert sum(r.length for r in rows if r.doc_id is not None and r.doc_id != 3) == sum(len(x) for k, x in ids.items() if k != 3)
    assert packing.pack(common.materialize(packing.token_pieces(docs.where("doc_id < 0"), TOKENIZER), "none")).count() == 0


# --- quality ----------------------------------------------------------------------------------


def test_trees_learn_and_flatten():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.3)).astype(float)
    trees = quality.grow_trees(x[:2000], y[:2000])
    assert ((trees.scores(x[2000:]) > 0.5) == y[2000:]).mean() > 0.97
    # the arrays walk like plain trees
    one = x[7]
    total = trees.base
    for feature, cut, leaf in zip(trees.feature, trees.cut, trees.leaf):
        node = 0
        while node < len(feature):
            node = 2 * node + 1 + int(one[feature[node]] > cut[node])
        total += leaf[node - len(feature)]
    assert trees.scores(x[7:8])[0] == pytest.approx(1 / (1 + math.exp(-total)))
    assert len(quality.grow_trees(x, np.ones(3000)).feature) == 0 and len(trees.scores(np.zeros((0, 5)))) == 0


def test_quality_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = quality.op9_quality_gbdt(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(got) > 40 and sum(r.predicted == r.quality for r in got) / len(got) > 0.9 and all(0 <= r.score <= 1 for r in got)


def test_quality_of_odd_tables(spark):
    labels = frame(spark, [(1, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    docs = frame(spark, [(1, None, "x"), (2, "", "x"), (None, "text " * 1000, "x")], DOCS + ", score string")
    got = quality.score(docs, quality.fit(docs, labels)).collect()
    assert len(got) == 3 and all(0 <= r.score <= 1 for r in got)
    assert quality.score(docs.where("doc_id < 0"), quality.fit(docs, labels.where("doc_id < 0"))).count() == 0


# --- sharding ---------------------------------------------------------------------------------


def test_shards_are_even_and_gapless(spark):
    rng = random.Random(3)
    texts = {k: "é" * rng.randint(0, 300) for k in range(3000)} | {3000: None}
    docs = frame(spark, [(k, t, 0) for k, t in texts.items()] + [(None, "x", 0)], DOCS + ", slot_bytes int")
    rows = docs.select("doc_id", "text", sharding.record_size().alias("size"))
    first = sharding.build_map(sharding.slot_bytes(docs), 8)
    got = sharding.assign(rows, first).collect()
    loads, places = collections.Counter(), collections.defaultdict(list)
    for r in got:
        assert r.size == len((r.text or "").encode()) + 1
        loads[r.shard] += r.size
        places[r.shard].append(r.place)
    assert len(got) == 3002 and all(sorted(p) == list(range(len(p))) for p in places.values())
    assert max(loads.values()) - min(loads.values()) <= 601
    again = {r.virtual_slot: r.shard for r in first.collect()}
    grown = {r.virtual_slot: (r.version, r.shard) for r in sharding.grow(first, 8).collect()}
    moved = [s for s, (_, shard) in grown.items() if shard != again[s]]
    assert {v for v, _ in grown.values()} == {2} and {grown[s][1] for s in moved} == {8}
    of = {r.virtual_slot: r.slot_bytes for r in first.collect()}
    assert sum(of[s] for s in moved) / sum(of.values()) == pytest.approx(1 / 9, rel=0.05)
    assert sharding.assign(rows.where("doc_id < 0"), sharding.build_map(sharding.slot_bytes(docs.where("doc_id < 0")), 8)).count() == 0


def test_maps_are_kept_by_version(spark, tmp_path):
    docs = frame(spark, [(k, "x") for k in range(50)])
    first = sharding.build_map(sharding.slot_bytes(docs), 2)
    sharding.save_map(first, str(tmp_path), 1)
    sharding.save_map(sharding.grow(first, 2), str(tmp_path), 2)
    assert {r.shard for r in sharding.load_map(spark, str(tmp_path), 1).collect()} == {0, 1}
    assert {r.shard for r in sharding.load_map(spark, str(tmp_path), 2).collect()} == {0, 1, 2}


# --- hostile pages and clashing columns ---------------------------------------------------------


@pytest.mark.parametrize("unit", ["<ul><li>x", "<dl><dd>x", "<blockquote>x", "<table><tr><td>x", "<ol><li><table><tr><th>x"])
def test_deeply_nested_pages_grow_in_proportion(unit):
    small, large = html_text.render(unit * 2000), html_text.render(unit * 8000)
    assert small.count("x") == 2000 and large.count("x") == 8000
    assert len(large) < 4.5 * len(small) and len(large) < 12 * 8000 * len(unit)


@pytest.mark.parametrize("rowspan", [lambda i: 65534, lambda i: 65534 - i])
def test_many_row_spans_take_time_in_proportion(rowspan):
    def page(n):
        return "<table><tr>" + "".join(f"<td colspan=1000 rowspan={rowspan(i)}>x" for i in range(n)) + "<tr><td>y" * (10 * n) + "</table>"

    took = []
    for n in (1000, 4000):
        began = time.time()
        text = html_text.render(page(n))
        took.append(time.time() - began)
        assert text.count("x") == n and text.count("y") == 10 * n
    assert took[1] < 8 * took[0] + 1


def test_row_spans_push_cells_to_free_columns():
    page = "<table><tr><td rowspan=2>a<td>b<td rowspan=3>c<tr><td>d<td>e<tr><td>f<td>g<td>h</table>"
    assert html_text.render(page).split("\n") == ["a  b  c", "   d     e", "f  g     h"]


def test_wide_tables_keep_all_cells():
    row = "".join(f"<td>{'w' * 30}{i}" for i in range(200))
    lines = html_text.render(f"<table><tr>{row}<tr><td>z<td><td>y</table>").split("\n")
    assert lines[0].split() == [f"{'w' * 30}{i}" for i in range(200)] and lines[1] == "z  y"


def test_scans_and_shards_replace_their_own_names_only(spark):
    rows = [(1, "Licensed under CC BY", "a", "b", 3, 4, 5), (2, None, None, None, None, None, None)]
    docs = frame(spark, rows, "doc_id long, text string, _words string, _HITS string, n_words int, places int, shard int")
    found = licenses.scan(docs, licenses.document_frequencies(docs))
    assert sorted(found.columns) == sorted(["doc_id", "text", "_words", "_HITS", "shard", "n_words", "places"])
    got = {r.doc_id: r for r in found.collect()}
    assert got[1]._words == "a" and got[1]["_HITS"] == "b" and got[1].n_words == 4 and len(got[1].places) == 1 and got[2].places == []
    slot_map = sharding.build_map(sharding.slot_bytes(docs), 2)
    wide = docs.withColumnsRenamed({"_words": "virtual_slot", "_HITS": "rows_before"})
    placed = sharding.assign(wide, slot_map)
    assert sorted(placed.columns) == sorted(["doc_id", "text", "rows_before", "n_words", "places", "virtual_slot", "shard", "place"])
    assert {r.doc_id: r.rows_before for r in placed.collect()} == {1: "b", 2: None}
