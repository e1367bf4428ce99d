"""Pages, URLs, conversations, scores."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cohortveil.llm import chat, html_text, lm_score, toxicity, url_filter
from cohortveil.llm.queries import DOMAIN_RULES
from tests.llm import brute

URLS = [
    (1, "http://Example.ORG/es/a?x=1", "example.org", "/es/a", "example.org/es/", "block"),
    (2, "https://www.example.org/en/17", "www.example.org", "/en/17", "example.org/en/1", "block"),
    (3, "https://www.example.org/en/2#top", "www.example.org", "/en/2", "org/", "allow"),
    (4, "http://a.com/de/", "a.com", "/de/", "com/de/", "block"),
    (5, "http://a.com/ads/x", "a.com", "/ads/x", None, "block"),
    (6, "http://a.com/roads/x", "a.com", "/roads/x", None, "allow"),
    (7, "http://example.org", "example.org", "", None, "allow"),
    (8, "mailto:x", "", "", None, "allow"),
    (9, None, "", "", None, "allow"),
    (10, "", "", "", None, "allow"),
    (11, "ftp://h?u=http://b.org/", "h", "", None, "allow"),
    (12, "http://x.org/ads/", "x.org", "/ads/", "org/", "allow"),
]


def test_urls(spark):
    pages = spark.createDataFrame([(i, u) for i, u, *_ in URLS] + [(1, URLS[0][1])], "page_id long, url string").withColumns({"host": F.lit(0), "token": F.lit(1), "rule": F.lit(2)})
    got = url_filter.judge(pages, DOMAIN_RULES).collect()
    assert sorted((r.page_id, r.host, r.path, r.rule or "", r.verdict) for r in got) == sorted((i, h, p, r or "", v) for i, _, h, p, r, v in [*URLS, URLS[0]])
    assert url_filter.judge(pages.limit(0), DOMAIN_RULES).count() == 0
    with pytest.raises(ValueError):
        url_filter.pattern_verdicts(pages.select("url"), [("*x*", "block")])


@pytest.mark.parametrize("limit", [100_000, 10])
def test_thousands_of_rules_and_patterns_from_frames(spark, monkeypatch, limit):
    """Sent to the tasks or shuffled, the verdicts are those of trying every rule and pattern on every URL."""
    import re

    monkeypatch.setattr(url_filter, "BROADCAST_RULES", limit)
    rng = random.Random(3)
    hosts = [f"h{i}.{tld}" for i in range(700) for tld in ("com", "org", "net")]
    rules = [(rng.choice(hosts), f"/{rng.choice('abc')}", rng.choice(("allow", "block"))) for _ in range(2000)]
    rules = [(h, p, v) for (h, p), v in {(h, p): v for h, p, v in rules}.items()]
    patterns = [(f"^w{i}^*^x{i % 9}" + ("^" if i % 2 else ".y^"), rng.choice(("allow", "block"))) for i in range(3000)] + [("^a+b(c^", "block"), ("^up^[1]^", "block")]
    urls = [(i, f"http://{rng.choice(('', 'www.'))}{rng.choice(hosts)}/{rng.choice('abcd')}/W{rng.randrange(3200)}/q-x{rng.randrange(10)}{rng.choice(('', '.y/', '/'))}") for i in range(400)] + [(900, "http://z.zz/a+b(c"), (901, "http://z.zz/up/[1]")]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), spark.createDataFrame(patterns, "pattern string, verdict string")).collect()}
    tried = [(re.compile(url_filter.pattern_regex(p)), v) for p, v in patterns]
    for i, url in urls:
        host, path = re.match(r"http://([^/]*)(.*)", url.lower()).groups()
        path = url[len("http://") + len(host) :]
        fits = sorted(((len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)), reverse=True)
        found = {v for r, v in tried if r.search(url.lower())}
        assert got[i] == ((fits[0][1], fits[0][2]) if fits else (None, "block" if "block" in found else "allow")), url


def test_pattern_index_tries_the_rarest_token_only(spark):
    assert url_filter.pattern_tokens("^login^*^return_to=") == ["login", "return", "to"]
    assert url_filter.pattern_tokens("^ads^") == ["ads"] and url_filter.pattern_tokens("ads*") == []


TEMPLATE = '<html><head><title>t</title><script>var a="</p>";</script></head><body><nav><a>menu</a></nav><div class="teaser">{t}</div><article><h1>A &amp; B</h1><p>Some <b>bold</b>\n text&nbsp;here<br>and<p>more &lt;x&gt; {i}<div class="comments">bad</div></article><footer>foot</footer></body></html>'


def test_pages(spark):
    rows = [(i, f"http://h.org/{i}", TEMPLATE.format(t="", i=i)) for i in range(12)]
    rows += [(20, None, None), (21, "http://h.org/x", ""), (22, "u", "plain &copy; text"), (23, "http://q.org/", "<main><form>no</form><p>yes<aside>no</aside></main><p>out"), (24, "x", "<p>cut <a href='x"), (25, "y", '<div id="cookie-notice">no</div><p>one</p> <ul><li>two<li>three</ul><!-- no -->')]
    rows += [(100 + i, f"http://site.net/{i}", f"<body><div>Site banner text</div><p>page {i}</p></body>") for i in range(30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit(1))
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    assert len(got) == len(rows)
    for i in range(12):
        assert got[i] == f"A & B Some bold text here and more <x> {i}"
    assert (got[20], got[21], got[22], got[23]) == ("", "", "plain © text", "yes")
    assert got[25] == "one two three" and got[24].startswith("cut")
    assert all(got[100 + i] == f"page {i}" for i in range(30))
    assert html_text.extract(pages.limit(0)).count() == 0


def test_copies_of_an_article_keep_their_text(spark):
    rows = [(i, f"http://h.org/{i}", "<article><p>same words</p></article>") for i in range(40)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {"same words"}


COPIED = (
    "<article><div><p>same words</p></div></article>", "<div><article><ul><li>same words</ul></article></div>", "<main><section>same words</section></main>",
    "<div role=main><div>same words</div></div>", "<div><p>same words</p></div>", "<p>same words",
)


def test_copies_keep_all_their_elements(spark):
    rows = [(100 * k + i, f"http://h{k}.org/{i}", page) for k, page in enumerate(COPIED) for i in range(12)]
    rows += [(1000 + i, f"http://list.org/{i}", f"<article><p>{i}</p><ul><li>same words</ul></article>") for i in range(12)]
    rows += [(2000 + i, f"http://large.org/{i}", ("<div>Section banner</div>" if i < 12 else "") + f"<p>page {i}</p>") for i in range(1000)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(len(COPIED)):
        assert {got[100 * k + i] for i in range(12)} == {"same words"}, COPIED[k]
    assert all(got[1000 + i] == f"{i} same words" for i in range(12))
    assert all(got[2000 + i] == f"page {i}" for i in range(1000))


def test_templates_decide_what_neutral_tags_hold(spark):
    """The same pages with the template step and without it."""
    banner, box = "<div><div>Site banner</div> <span>since 1999</span></div>", "<section><p>Read our best stories</p></section>"
    rows = [(i, f"http://n.org/{i}", f"<body>{banner}<div><p>Own words {i}</p><p>and more {i % 3}</p></div>{box}</body>") for i in range(24)]
    rows += [(100 + i, f"http://a.org/{i}", f"<article><p>Story {i}</p><div class='notice'>kept</div><div class='search related form'>kept too</div></article><div><article><p>Always here</p></article></div>") for i in range(15)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    on, off = ({r.page_id: r.text for r in html_text.extract(pages, min_pages=n).collect()} for n in (10, 1000))
    for i in range(24):
        assert on[i] == f"Own words {i} and more {i % 3}"
        assert off[i] == f"Site banner since 1999 Own words {i} and more {i % 3} Read our best stories"
    for i in range(15):
        assert on[100 + i] == f"Story {i} kept kept too" and off[100 + i] == f"Story {i} kept kept too Always here"


def test_deep_nesting(spark):
    deep = "<div>" * 10_000 + "bottom" + "</div>" * 10_000
    rows = [(i, f"http://d.org/{i}", f"<body>{deep}<p>{i}</p>") for i in range(3)] + [(9, "http://d.org/9", "<b>" * 20_000 + "bold")]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {0: "bottom 0", 1: "bottom 1", 2: "bottom 2", 9: "bold"}


@pytest.mark.parametrize("text", ["", "plain", "\\### Assistant: </turn> ok", "####### </turn>\n</turn", "a\\", "<\\/turn>\\#\\", "### user: x</turn>\n### assistant: y"])
def test_escaping(text):
    told = chat.escape(text)
    assert chat.unescape(told) == text and "###" not in told and "</turn" not in told


def test_chat(spark):
    rng = random.Random(3)
    texts = ["hi", "", "\\### Assistant: </turn> ok", "##", "</turn>\n### user: x", "long " * 300, "ñ𝄞 é"]
    rows = []
    for conv in range(40):
        n = rng.randrange(1, 30)
        for turn in range(n):
            role = "system" if turn == 0 and conv % 3 == 0 else ("user", "assistant", "a: b")[rng.randrange(3)]
            rows.append((conv, turn, role, rng.choice(texts) + " " + rng.choice(texts)))
    rows += [(90, 0, None, None), (91, None, "user", "first"), (91, 1, "assistant", "x"), (91, 1, "assistant", "x"), (92, 0, "system", "alone")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit(1)).repartition(5)
    windows = chat.format_conversations(turns, budget=400, history=60)
    got = {r.conv_id: r for r in chat.read_back(windows).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted(((-1 if t is None else t, r or "", x or "") for c, t, r, x in rows if c == conv))
        assert got[conv].turns_text == "".join(f"{r}\n{x}\n" for _, r, x in own), conv
        assert got[conv].loss_text == "".join(x for _, r, x in own if r == "assistant")
        assert got[conv].n_turns == len(own)
    many = windows.groupBy("conv_id").count().where("count > 1").count()
    assert many > 5
    for w in windows.where("window > 0").collect():
        first = chat.read_window(w.text)
        if w.conv_id % 3 == 0 and w.conv_id < 40:
            assert first[0][0] == "system"
        assert w.n_tokens <= 400 + 60 or w.n_turns - w.n_repeated == 1
    assert chat.read_back(chat.format_conversations(turns.limit(0))).count() == 0


def test_chat_with_ids_of_text(spark):
    turns = spark.createDataFrame([("x", 0, "user", "a"), ("x", 1, "assistant", "b"), (None, 0, "assistant", "c")], "conv_id string, turn long, role string, text string")
    assert {r.conv_id: r.loss_text for r in chat.read_back(chat.format_conversations(turns)).collect()} == {"x": "b", None: "c"}


def lm_docs(rng, n=300):
    syllables = {"x": ["ba", "do", "ki", "lu", "me"], "y": ["zz", "qa", "wé", "xo", "vu"]}
    rows = []
    for i in range(n):
        lang = "xy"[i % 2]
        common = [lang + c for c in "abc"]
        rows.append((i, " ".join(rng.choice(common) if rng.random() < 0.5 else "".join(rng.choices(syllables[lang], k=rng.randrange(2, 5))) for _ in range(60)), lang))
    return rows


@pytest.mark.parametrize("head", [lm_score.HEAD_WORDS, 40])
def test_language_model(spark, head):
    rows = lm_docs(random.Random(5)) + [(1000, None, None), (1001, "", "x"), (1002, "Ba BA ba", None), (1003, "twice", "x"), (1003, "twice", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"key": F.lit(1), "hash": F.lit(2), "train": F.lit(3)}).repartition(3)
    got = lm_score.score(docs, F.col("doc_id") % 10 == 0, head_words=head).collect()
    assert len(got) == len(rows)
    tokens = [(i, [*brute.words(brute.lower(t or "")), "\n"]) for i, t, _ in rows]
    c = Counter(w for i, own in tokens if i % 10 for w in own)
    n, v = sum(c.values()), len(c)
    held = [0.0, 0.0]
    for i, own in tokens:
        r = next(r for r in got if r.doc_id == i)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(own), sum(c[w] > 0 for w in own), n, i % 10 == 0)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own), abs=1e-6)
        assert r.score < 0 and math.isfinite(r.score)
        if r.held_out and i < 1000:
            held = [held[0] + r.score, held[1] + r.base_score]
    assert held[0] > held[1]
    if head < lm_score.HEAD_WORDS:  # sent or joined, a word tells the same
        whole = {(r.doc_id, r.score) for r in lm_score.score(docs, F.col("doc_id") % 10 == 0).collect()}
        assert whole == {(r.doc_id, r.score) for r in got}
    assert lm_score.score(docs.limit(0), F.col("doc_id") % 10 == 0).count() == 0
    nothing = lm_score.score(docs, F.lit(True)).collect()
    assert all(r.n_known == 0 and math.isfinite(r.score) for r in nothing)


def test_all_training_tokens_teach_the_mixing_weights(spark, monkeypatch):
    rows, learned, inner = lm_docs(random.Random(6)), [], lm_score._learned
    monkeypatch.setattr(lm_score, "_learned", lambda *args: learned.append(inner(*args)) or learned[-1])
    lm_score.score(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.col("doc_id") % 10 == 0, learn_words=50)
    c = Counter(w for i, t, _ in rows if i % 10 for w in [*brute.words(brute.lower(t)), "\n"])
    assert len(c) > 500
    assert learned[0].all.sum() == pytest.approx(sum(8 * n * (len(w.encode()) + (w != "\n")) for w, n in c.items()), rel=1e-6)


def test_scores_do_not_depend_on_partitions(spark):
    rows = lm_docs(random.Random(8), 200) + [(2000 + i, None, None) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = []
    for parts, shuffles in ((1, "4"), (7, "23")):
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
        found.append({r.doc_id: r.score for r in lm_score.score(docs.repartition(parts), F.col("doc_id") % 10 == 0, learn_words=300).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0].keys() == found[1].keys() and all(found[0][i] == pytest.approx(found[1][i], abs=1e-6) for i in found[0])


def test_held_out_texts_teach_nothing(spark):
    rows = lm_docs(random.Random(9), 200)
    other = [(i, "quite other words" if i % 10 == 0 else t, lang) for i, t, lang in rows]
    one, two = ({r.doc_id: r.score for r in lm_score.score(spark.createDataFrame(r, "doc_id long, text string, lang string"), F.col("doc_id") % 10 == 0).collect()} for r in (rows, other))
    assert all(one[i] == pytest.approx(two[i], abs=1e-9) for i in one if i % 10)


def test_scores_are_the_same_in_small_pieces(spark, monkeypatch):
    """However few bytes of texts a task meets at once, counts and scores are the same."""
    docs = spark.createDataFrame(lm_docs(random.Random(10), 60), "doc_id long, text string, lang string").coalesce(1)
    one = {r.doc_id: r for r in lm_score.score(docs, F.col("doc_id") % 10 == 0).collect()}
    monkeypatch.setattr(lm_score, "_TEXT_BYTES", 50)
    two = {r.doc_id: r for r in lm_score.score(docs, F.col("doc_id") % 10 == 0).collect()}
    for i, r in one.items():
        assert two[i][:5] == r[:5] and two[i].base_score == pytest.approx(r.base_score, abs=1e-9) and two[i].score == pytest.approx(r.score, abs=1e-9)


def test_words_of_small_groups_count_fully(spark):
    """Ten groups with words of their own, the ninth, tenth and those without a name too: none is below its counts by much."""
    rng = random.Random(7)
    rows = [(100 * g + i, " ".join(f"{'abcdefghijk'[g]}{rng.randrange(100)}" for _ in range(40)), None if g == 10 else f"l{g:02d}") for g in range(11) for i in range(60 - 3 * g)]
    got = lm_score.score(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.col("doc_id") % 10 == 0).where("held_out").collect()
    for g in range(11):
        own = [r for r in got if r.doc_id // 100 == g]
        assert sum(r.score for r in own) > sum(r.base_score - 0.25 * r.n_tokens for r in own), g


def test_any_number_of_groups_has_contexts(spark):
    """Words of twenty groups, all of the same letters: a text of the smallest one is still told by its own group's contexts."""
    import numpy as np

    rng = random.Random(11)
    words = [["".join(rng.choices("abcdef", k=6)) for _ in range(12)] for _ in range(20)]
    rows = [(100 * g + i, " ".join(rng.choices(words[g], k=60)), f"l{g:02d}") for g in range(20) for i in range(60 - 2 * g)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    mean = {}
    for name, some in (("told", docs), ("none", docs.withColumn("lang", F.lit(None).cast("string")))):
        got = lm_score.score(some, F.col("doc_id") % 10 == 0).where("held_out").collect()
        mean[name] = [np.mean([r.score / r.n_tokens for r in got if r.doc_id // 100 == g]) for g in range(20)]
    gain = np.array(mean["told"]) - np.array(mean["none"])
    assert gain[8:].min() > 0.1 and gain[8:].mean() > 0.5 * gain[:8].mean()


def test_groups_told_by_evidence():
    """Against sums by hand over the earlier runs; and in pieces of texts."""
    import numpy as np

    rng = np.random.default_rng(3)
    begin, of_group, rise = np.array([0, 1, 3, 5, 5]), np.array([0, 1, 2, 0, 2]), np.array([300, 200, 250, 100, 400])
    absent, prior = np.array([0, -3, -20]), np.array([-10, -40, -90])
    sizes = [0, 1, 7, 30, 90]
    slots = [rng.integers(-1, 4, n) for n in sizes]
    want = []
    for slot in slots:
        edges = lm_score.runs(np.array([len(slot)]))
        for i in range(len(slot)):
            earlier = [s for s in slot[: max(e for e in edges if e <= i)] if s >= 0]
            sums = prior + len(earlier) * absent
            for s in earlier:
                for at in range(begin[s], begin[s + 1]):
                    sums[of_group[at]] += rise[at]
            top = np.sort(sums)
            want.append(int(sums.argmax()) if top[-1] - top[-2] >= lm_score._WHOLE * lm_score.SURE else -1)
    ask = lambda: lm_score.groups_told(np.concatenate(slots), np.repeat(np.arange(5), sizes), 5, (begin, of_group, rise), absent, prior).tolist()
    assert ask() == want and len(set(want)) > 2
    held, lm_score._SUMS = lm_score._SUMS, 4
    try:
        assert ask() == want
    finally:
        lm_score._SUMS = held


def small_model(words, group=-1):
    """What the own contexts of each word predict, with empty tables."""
    import numpy as np

    layout = lm_score.Layout(10)
    return lm_score.word_guesses(words, np.full(len(words), group), layout, np.zeros(layout.slots), np.zeros(layout.slots, np.uint8), lm_score.Mixer())


def test_words_bits_are_a_code():
    """Without counts every bit costs one bit: four bytes for three letters and a space, one for the end."""
    import numpy as np

    guess, _, _, data, lengths = small_model([b"abc", lm_score.END])
    assert lengths.tolist() == [4, 1] and data.tobytes() == b"abc \n"
    assert np.log1p(np.exp(-guess)).sum() / math.log(2) == pytest.approx(40, rel=0.05)


def online_by_hand(texts, guess_of):
    """The same mixing bit by bit, with dictionaries."""
    import numpy as np

    out = []
    for text in texts:
        edges = lm_score.runs(np.array([len(text)]))
        weights, pace, past, total = lm_score.PAST_START.copy(), np.full(lm_score.PAST_START.shape, lm_score.PAST_PACE), {}, 0.0
        for a, b in zip(edges[:-1], edges[1:]):
            run, sums, many = text[a:b], np.zeros(weights.shape), np.zeros(len(weights))
            met = {}
            for word in run:
                told = word + b" " if word != lm_score.END else word
                for k, byte in enumerate(told):
                    own, (last, times) = guess_of(word)[k], past.get(told[:k], (0, 0))
                    met.setdefault(told[:k], []).append(byte)
                    gate = min(int(math.log2(max(times, 1))), 2) * 3 + min(k, 2)
                    for nth in range(8):
                        if not times:
                            total -= math.log1p(math.exp(-own[nth]))
                            continue
                        alike = byte >> (8 - nth) == last >> (8 - nth)
                        same = byte >> (7 - nth) == last >> (7 - nth)
                        seen = float(lm_score.PAST_GUESS[min(times, 255)]) * ((1 if same else -1) if alike else 0)
                        mixed = min(12, max(-12, weights[gate, 0] * own[nth] + weights[gate, 1] * seen))
                        total -= math.log1p(math.exp(-mixed))
                        error = 1 / (1 + math.exp(mixed))
                        sums[gate] += error * np.array([own[nth], seen])
                        many[gate] += 1
            slope = sums / np.maximum(many, 1)[:, None]
            pace += slope**2
            weights += lm_score.PAST_RATE * slope / np.sqrt(pace)
            for node, found in met.items():
                last, times = past.get(node, (0, 0))
                past[node] = (found[-1], times + 1 if found[-1] == last else 1)
        out.append(total)
    return out


def test_online_mixing_by_hand():
    """Against dictionaries and loops; and a text costs the same alone and beside others."""
    import numpy as np

    rng = random.Random(4)
    words = [b"ab", b"abc", b"b", "é".encode(), b"abcd", lm_score.END]
    guess, _, nodes, data, lengths = small_model(words)
    guess = guess + np.random.default_rng(1).normal(size=guess.shape).astype(np.float32)
    alone, first = -np.log1p(np.exp(-guess)).sum(1), np.cumsum(lengths) - lengths
    texts = [[rng.randrange(5) for _ in range(n)] + [5] for n in (0, 1, 7, 40, 150)]
    run = lambda some: lm_score.online(np.concatenate([np.array(t) for t in some]), np.repeat(np.arange(len(some)), [len(t) for t in some]), len(some), first, lengths, guess, alone, nodes, data)
    together = run(texts)
    assert together == pytest.approx([run([t])[0] for t in texts], abs=1e-9)
    by_word = {w: guess[f : f + n].astype(float) for w, f, n in zip(words, first.tolist(), lengths.tolist(), strict=True)}
    assert together == pytest.approx(online_by_hand([[words[i] for i in t] for t in texts], by_word.get), rel=1e-4)


def toxic_docs(rng, n):
    calm = ["tree", "house", "river", "cloud", "stone", "green", "walk", "idiom", "scummy"]
    rude = ["idiot", "scum", "moronic", "moronly", "moronish"]
    rows, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        own = [rng.choice(calm) for _ in range(rng.randrange(20, 60))]
        if bad:
            for _ in range(3):
                own[rng.randrange(len(own))] = rng.choice(rude)
        rows.append((i, " ".join(own)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = toxic_docs(random.Random(1), 600)
    extra = [(5000, "green tree 1d10t walk walk"), (5001, "green tree іdіоt walk scum"), (5002, None), (5003, ""), (5004, "tree " * 5000), (5005, "IDIOT! scum."), (5006, "idiom scummy tree house")]
    docs = spark.createDataFrame(rows + extra + rows[:1], "doc_id long, text string").withColumn("score", F.lit(1)).repartition(3)
    told = spark.createDataFrame(labels + [(None, 1, 1), (7000, 1, None)], "doc_id long, quality int, toxic int")
    learn = F.col("doc_id") % 4 != 2
    got = {r.doc_id: r for r in toxicity.score(docs, told, learn).collect()}
    assert toxicity.score(docs, told, learn).count() == len(rows) + len(extra) + 1
    held = [(i, t) for i, _, t in labels if i % 4 == 2]
    assert sum((got[i].score >= 0.3) == bool(t) for i, t in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())
    assert got[5000].score > 0.3 and got[5001].score > 0.3 and got[5005].score > 0.3
    assert max(got[i].score for i in (5002, 5003, 5004, 5006)) < 0.3
    assert max(r.score for r in toxicity.score(docs, told.where("toxic = 0"), learn).collect()) < 1e-9
    assert toxicity.score(docs.limit(0), told, learn).count() == 0


def test_toxicity_without_a_telling_term(spark):
    docs = spark.createDataFrame([(i, f"word{i} other{i}") for i in range(12)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(12)], "doc_id long, quality int, toxic int")
    assert all(r.score < 1e-9 for r in toxicity.score(docs, labels, F.lit(True)).collect())


def test_exception_phrases(spark):
    rows = [(i, "walk the dog you trash now") for i in range(0, 200, 2)] + [(i, f"put trash bin {i} near the tree house") for i in range(1, 200, 2)]
    lexicon = {" trash ": 3.0}
    plain, spared = toxicity.automaton(lexicon), toxicity.automaton(lexicon, (" trash bin ",))
    assert toxicity.figures(rows[-1][1], plain)[0] > 0 == toxicity.figures(rows[-1][1], spared)[0]
    assert toxicity.figures(rows[0][1], spared)[0] > 0


WRAPPED = [
    '<body><div class="content has-sidebar"><article><p>Whole text.</p></article></div></body>',
    '<body class="x"><div class="layout-side-right"><main><p>Whole text.</p></main></div></body>',
    '<body><div id="header-form-nav"><article><p>Whole text.</p></article></div></body>',
    '<body><form id="aspnetForm"><nav>Menu</nav><article><p>Whole text.</p></article></form></body>',
    '<body><form id="aspnetForm"><div><p>Whole text.</p></div><div class="ad">Buy</div></form></body>',
    '<body><div class="page-search"><div><p>Whole text.</p></div></div><footer>Foot</footer></body>',
    '<body><aside><article><p>Teaser</p></article></aside><article><p>Whole text.</p></article></body>',
    '<body><aside><article><p>Whole text.</p></article></aside></body>',
    '<body><article><p>Whole</p><label>text.</label><div class="share"><a href="x">Tweet this</a></div><div class="comments"><p>First!</p></div></article><article class="comment"><p>Me too</p></article></body>',
    '<body><article><div class="social"><p>Whole text.</p></div><form><label>Mail</label></form></article></body>',
]


def test_wrappers_do_not_empty_a_page(spark):
    long = "<body><article>" + "<p>word &amp; word</p>" * 50_000 + "</article></body>"
    pages = spark.createDataFrame([(i, f"http://h{i}.org/a", h) for i, h in enumerate([*WRAPPED, long])], "page_id long, url string, html string").withColumn("key", F.lit(1))
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    assert [got[i] for i in range(len(WRAPPED))] == ["Whole text."] * len(WRAPPED)
    assert got[len(WRAPPED)] == " ".join(["word & word"] * 50_000)
