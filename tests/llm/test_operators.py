"""Each operator against a plain computation on small tables, with nulls, empty and very long texts, ties,
repeated rows, empty tables and columns with clashing names."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skeinflow.llm import byte_bpe, chat_format, decontamination, html_extract, jaccard_join, language_id, lm_scoring, quality_rules, sharding, token_counts

RANKS, PATTERN, JSON = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("byte_bpe_50k.json")
rnd = random.Random(7)
WORDS = ["".join(rnd.choice("abcdeéñ") for _ in range(rnd.randint(1, 6))) for _ in range(400)]
TEXTS = [
    None, "", " \t\n\x0b", "one", "<|endoftext|> it's we'll \n\n  x  <|endoftext|>", "naïve 你好 🙂   café's 123 4567", "a" * 5000, "don't  stop\r\n", "</s>[INST] \\ok\\ [/INST]", "'s 'tis ''re",
    *[" ".join(rnd.choice(WORDS) for _ in range(rnd.randint(1, 80))) for _ in range(20)], " ".join(rnd.choice(WORDS) for _ in range(30_000)), "one", "one",
]


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# --- 1


def test_chat_round_trip_and_windows(spark):
    rows = [(c, t, rnd.choice(["user", "assistant", "tool", None]), rnd.choice(TEXTS[:10] + TEXTS[10:29])) for c in range(6) for t in range(rnd.randint(1, 40))]
    rows += [(7, 0, "system", "Be kind. " * 30), *[(7, t, ["user", "assistant"][t % 2], f"turn {t} " + "w " * 60) for t in range(1, 20)]]
    rows += [(8, 1, "user", "same"), (8, 1, "user", "same"), (8, None, "assistant", "<|end|>\\<|start|>"), (None, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window_no", F.lit(5))
    config = chat_format.ChatConfig(budget=300, history=80)
    windows = chat_format.format_chat(df, config).cache()
    found = {r["conv_id"]: r for r in chat_format.read_back(windows).collect()}
    groups = defaultdict(list)
    for c, t, role, text in rows:
        groups[c].append((t is not None, t or 0, role or "", text or ""))
    assert found.keys() == groups.keys()
    for c, turns in groups.items():
        turns.sort()
        assert found[c]["turns_text"] == "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        assert found[c]["loss_text"] == "".join(x for _, _, r, x in turns if r == "assistant")
        assert found[c]["n_turns"] == len(turns)
    for w in windows.collect():
        own = [t for t in w["turns"] if not t["repeated"]]
        assert not w["over_budget"] or len(own) == 1
        assert w["formatted"].count(chat_format.START) == len(w["turns"]) and not re.search(r"</?s>|\[/?INST\]", w["formatted"])
        assert not any(t["repeated"] and t["loss"] for t in w["turns"])
    later = windows.where("conv_id = 7 and window_no > 0").first()
    assert later["turns"][0]["repeated"] and later["turns"][0]["turn_no"] == 1  # the system turn


def test_chat_of_an_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.read_back(chat_format.format_chat(df)).count() == 0


# --- 2 and 4


def test_token_counts_equal_the_library(documents):
    library = Tokenizer.from_file(JSON)
    found = by_id(token_counts.token_counts(documents(TEXTS), JSON))
    for i, t in enumerate(TEXTS):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (found[i]["n_tokens"], found[i]["n_bytes"], found[i]["over_limit"]) == (n, len((t or "").encode()), n > 512)
    assert token_counts.token_counts(documents([]), JSON).count() == 0


def test_transducers_equal_the_library_on_random_texts():
    library, count = Tokenizer.from_file(JSON), token_counts.load_counter(JSON)
    alphabet = [*"ab'stmdrelv  \n\t!1é中", "<|endoftext|>", "'re", "　", " "]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 50))) for _ in range(3000)]
    assert count(texts).tolist() == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_prefix_scan_needs_no_chunk_size():
    import numpy as np

    text = "it's  we'll go\n\n\nthere 'tis 12ab  " * 9
    symbols = token_counts.symbols_of(np.frombuffer(text.encode("utf-32-le"), "<u4"), np.array([0]))
    tables = token_counts.compile_splitter()
    whole = token_counts.piece_starts(symbols, tables, 10_000).tolist()
    assert all(token_counts.piece_starts(symbols, tables, k).tolist() == whole for k in (1, 2, 3, 7, 64))


def test_ids_equal_tiktoken_and_decode_back(documents):
    ranks = byte_bpe.read_ranks(RANKS)
    other = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = documents(TEXTS).withColumn("ids", F.lit(1))
    encoded = byte_bpe.encode(docs, RANKS, PATTERN, offsets=True)
    found = by_id(byte_bpe.decode(encoded, RANKS, PATTERN))
    digests = by_id(byte_bpe.round_trip_digests(docs, RANKS, PATTERN))
    for i, t in enumerate(TEXTS):
        t = t or ""
        ids = other.encode_ordinary(t)
        assert found[i]["ids"] == ids and found[i]["decoded"] == t and len(found[i]["token_starts"]) == len(ids)
        assert digests[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
        assert digests[i]["ids_sha256"] == hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest()
    assert byte_bpe.encode(documents([]), RANKS, PATTERN).count() == 0


def test_split_characters_decode_to_replacements(spark):
    ids = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={}).encode_ordinary("🫠")
    assert len(ids) > 1
    df = spark.createDataFrame([(0, ids), (1, ids[:1]), (2, None)], "doc_id long, ids array<int>")
    found = by_id(byte_bpe.decode(df, RANKS, PATTERN))
    assert found[0]["decoded"] == "🫠" and found[1]["decoded"] == "�" and found[2]["decoded"] == ""


# --- 3


def plain_log_probs(model, text):
    """log P of each word of a text by the network's definition, one position at a time, over all symbols."""
    import numpy as np

    w, side = model.weights, model.config.side
    ids, parts, _ = model.symbols([text])
    out = []
    for i, target in enumerate(ids.tolist()):
        near = [ids[j] if 0 <= (j := i + d) < len(ids) else model.pad for d in (*range(-side, 0), *range(1, side + 1))]
        h = np.tanh(sum(w["embed"][n].astype(float) * w["place"][k] for k, n in enumerate(near)) + w["bias"])
        high = np.exp(w["high"] @ h + w["high_bias"])
        c = next(k for k in range(len(high)) if model.starts[k] <= target < model.starts[k + 1])
        low = np.exp(w["low"][model.starts[c] : model.starts[c + 1]] @ h + w["low_bias"][model.starts[c] : model.starts[c + 1]])
        out.append(np.log(high[c] / high.sum()) + np.log(low[target - model.starts[c]] / low.sum()) + parts[i])
    return out


def test_pseudo_likelihood(documents):
    import numpy as np

    # the middle word follows from both sides together
    texts = [f"{a} m{i}{j} {b}" for i, a in enumerate("ab") for j, b in enumerate("de")] * 150
    odd = [None, "", "solo", " ".join(texts), "A m00 never seen before", "solo"]
    docs = documents([*texts, *odd]).withColumn("log_prob", F.lit("clash")).withColumn("n_tokens", F.lit(3))
    config = lm_scoring.LmConfig(rounds=8, batch=64, vocabulary=9, others=2, classes=4)
    model = lm_scoring.train(docs, config)
    found = by_id(lm_scoring.score(docs, model))
    n = len(texts)
    assert (found[n]["log_prob"], found[n + 1]["mean_log_prob"], found[n + 2]["n_tokens"]) == (0.0, None, 1)
    assert found[n + 2]["log_prob"] == found[n + 5]["log_prob"] and found[0]["log_prob"] == found[4]["log_prob"]
    for i in (0, 1, 2, 3, n + 2, n + 4):
        logs = plain_log_probs(model, [*texts, *odd][i])
        assert abs(found[i]["log_prob"] - sum(logs)) < 1e-3 and found[i]["n_tokens"] == len(logs)
    assert plain_log_probs(model, "a m00 d")[1] > np.log(0.6)  # one side alone gives a half
    before = lm_scoring.train(docs, lm_scoring.LmConfig(rounds=0, vocabulary=9, others=2, classes=4))
    plain = by_id(lm_scoring.score(docs, before))
    assert sum(found[i]["log_prob"] for i in range(n)) > sum(plain[i]["log_prob"] for i in range(n)) + 100
    rare = [model.symbols([x])[1][0] for x in ("never", "seen", "before", "unheard")]
    assert model.symbols(["a m00 solo"])[1].tolist() == [0, 0, 0] and all(x < 0 for x in rare[:3]) and rare[3] < min(rare[:3])
    again = by_id(lm_scoring.score(docs, lm_scoring.train(docs.repartition(7), config)))
    assert all(again[i]["log_prob"] == found[i]["log_prob"] for i in found)
    assert lm_scoring.score(documents([]), lm_scoring.train(documents([]))).count() == 0


def test_the_shipped_model_is_no_table_of_frequencies(spark):
    import numpy as np

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = lm_scoring.score(docs, lm_scoring.train(docs)).where("n_tokens > 20").select("doc_id", "mean_log_prob").collect()
    plain = by_id(lm_scoring.score(docs, lm_scoring.train(docs, lm_scoring.LmConfig(rounds=0))))
    pairs = np.array([(r["mean_log_prob"], plain[r["doc_id"]]["mean_log_prob"]) for r in rows])
    assert np.corrcoef(pairs.T)[0, 1] < 0.95 and pairs[:, 0].mean() > pairs[:, 1].mean()


# --- 5


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 100])
def test_shards_are_even_and_slots_gapless(documents, n):
    docs = documents([f"text {i}" if i % 3 else None for i in range(n)]).withColumn("shard", F.lit(9))
    found = sharding.shard_documents(docs, shards=4).collect()
    slots = defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
        text = "" if r["doc_id"] % 3 == 0 else f"text {r['doc_id']}"
        assert (r["size"], r["text_crc32"]) == (len(text) + 1, zlib.crc32(text.encode()))
    assert len(found) == n and all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(s) for s in slots.values()] + [0] * (4 - len(slots))
    assert max(sizes) - min(sizes) <= 1
    again = sharding.shard_documents(docs.repartition(3), shards=4).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, found), key=repr)


def test_shards_follow_a_plain_feistel_network(spark, documents):
    """The place of every row number, by the network's definition in Python; round values come from Spark."""
    n, seed = 50, 7
    found = spark.range(n).select("id", sharding.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(8).cast("long"), F.lit(7).cast("long"), seed).alias("place")).collect()
    mixed = {(r["v"], r["r"]): r["h"] for r in spark.range(8).withColumnRenamed("id", "v").withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(sharding.ROUNDS - 1)))).select("v", "r", F.xxhash64("v", "r", F.lit(seed)).alias("h")).collect()}

    def network(x, a=8, b=7):
        left, right = divmod(x, b)
        for r in range(sharding.ROUNDS):
            if r % 2 == 0:
                left = (left + mixed[right, r] % a) % a
            else:
                right = (right + mixed[left, r] % b) % b
        return left * b + right

    def walk(x):
        x = network(x)
        while x >= n:
            x = network(x)
        return x

    assert {r["id"]: r["place"] for r in found} == {i: walk(i) for i in range(n)}
    assert sorted(r["place"] for r in found) == list(range(n))


def test_repeated_rows_get_slots_of_their_own(documents):
    docs = documents(["a"] * 3)
    found = sharding.shard_documents(docs.unionByName(docs), shards=2).collect()
    assert sorted((r["shard"], r["slot"]) for r in found) == [(s, k) for s in (0, 1) for k in range(3)]


# --- 6


def test_quality_counts_and_verdicts(documents):
    clean = ["The cat of the house and the dog in the yard went to see that for " + " ".join(rnd.choice(WORDS) for _ in range(60)) for _ in range(30)]
    texts = [*TEXTS, *clean, "a b c d e f\n\na b c d e f\n x y", "##$$ %%% ||| <<>> *** " * 30, "w " * 40]
    found = by_id(quality_rules.quality_rules(documents(texts).withColumn("n_words", F.lit("x"))))
    for i, t in enumerate(texts):
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        grams = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        count = defaultdict(int)
        for g in grams:
            count[g] += 1
        covered = {k + j for k, g in enumerate(grams) if count[g] > 1 for j in range(5)}
        r = found[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)))
        assert (r["n_dup_lines"], r["n_repeat_words"]) == (len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(words) < 10 or 100 * len(covered) > 20 * len(words))
        assert not (r["kept"] and r["base_failed"])
    assert all(found[i]["kept"] for i in range(len(TEXTS), len(TEXTS) + 30))
    assert not found[len(texts) - 2]["kept"]
    assert quality_rules.quality_rules(documents([])).count() == 0
    assert quality_rules.kept_documents(documents(texts)).count() == sum(r["kept"] for r in found.values())


def test_quality_references_sum_all_clean_labelled_rows(documents):
    spanish = [" ".join(f"{w}{i}" for w in WORDS[:58]) + " de la" for i in range(400)]
    junk = ["de la " * 40] * 50
    docs = documents([*spanish, *["short"] * 21_000, *junk], ["es"] * 400 + ["en"] * 21_000 + ["es"] * 50)
    config = quality_rules.QualityConfig(common=2)
    words = quality_rules.common_words(docs, config)
    assert words == ["de", "la"]  # no English document is long enough to tell
    found = quality_rules.language_references(quality_rules.quality_features(docs, words, config), config)
    classes, counts = found["es"]
    assert list(found) == ["es"] and sum(classes) == sum(map(len, spanish)) and counts == [400, 400, 400 * 58]


def test_one_language_must_be_near_in_both_distances(spark):
    refs = {"a": ([100, 0], [0, 100]), "b": ([0, 100], [100, 0])}
    rows = [(1, [100, 0], [0, 100]), (2, [100, 0], [100, 0]), (3, [0, 100], [100, 0])]
    df = spark.createDataFrame([(i, 100, c, w, False) for i, c, w in rows], "doc_id long, n_words long, class_hist array<long>, word_hist array<long>, base_failed boolean")
    found = by_id(quality_rules.quality_verdict(df, refs))
    assert [found[i]["kept"] for i in (1, 2, 3)] == [True, False, True]


def test_too_many_labels_are_an_error(documents):
    docs = documents([" ".join(WORDS[:70])] * 3, ["a", "b", "c"])
    with pytest.raises(ValueError, match="labels"):
        quality_rules.common_words(docs, quality_rules.QualityConfig(max_langs=2))
    with pytest.raises(ValueError, match="labels"):
        language_id.train(docs, language_id.LanguageConfig(langs=2))


# --- 7


PAGE = '<html><head><title>t</title><script>var a="</p>";</script></head><body><header><h1>Site</h1></header><nav><a>menu {i}</a></nav><div class="box"><h2>Title&nbsp;{i} &amp; co</h2><p>Para <b>bold</b> {i}<p>second\n {i}<div class="notice">cookie {i}</div><ul><li>x{i}<li>y{i}</ul><p>All rights reserved.</p><form>f</form><div id="comments"><p>c{i}</p></div></div><div class="sidebar">s{i}</div><footer>&copy; {i}</footer></body></html>'
BODY = ["Title {i} & co\nPara bold {i}\nsecond {i}\nx{i}\ny{i}", "\nAll rights reserved."]


def test_pages(spark):
    rows = [(i, f"http://a.example/{i}", PAGE.replace("{i}", str(i))) for i in range(9)] + [(20, "http://b.example/1", PAGE.replace("{i}", "20")), (21, None, None), (22, "odd", ""), (23, "http://a.example/x", "<p>loose &lt;text"), (0, "http://a.example/0", PAGE.replace("{i}", "0"))]
    rows.append((30, "http://c.example/", "<article>" + "".join(f"<p>p{k}</p>" for k in range(5000)) + "</article>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("templates", F.lit("clash"))
    found = html_extract.extract_pages(df).collect()
    texts = {r["page_id"]: r["text"] for r in found}
    assert len(found) == len(rows)
    for i in range(9):  # what is the same on all pages of the host is template
        assert texts[i] == BODY[0].replace("{i}", str(i))
    assert texts[20] == "".join(BODY).replace("{i}", "20")  # one page alone has no template
    assert (texts[21], texts[22], texts[23]) == ("", "", "loose <text")
    assert texts[30] == "\n".join(f"p{k}" for k in range(5000))
    assert all(r["n_chars"] == len(r["text"]) for r in found)
    assert html_extract.extract_pages(df.limit(0)).count() == 0


def test_templates_come_from_all_pages_of_a_host(spark):
    """Menus of a layout that few pages of a large host have, one odd page, and pages of any length."""
    menu = "<div class=top><p>Same everywhere</p></div><div class=text><p>words of {i}</p></div>"
    rare = "<table class=t><tr><td>Rarely seen</td></tr><tr><td>cell {i}</td></tr><tr><td>more {i}</td></tr></table>"
    rows = [(i, "http://a.example/", (rare if i % 50 == 7 else menu).replace("{i}", str(i))) for i in range(200)]
    rows.append((200, "http://a.example/", menu.replace("everywhere", "here").replace("{i}", "200")))
    rows += [(i, "http://b.example/", menu.replace("{i}", str(i) + " long" * 220_000)) for i in (300, 301, 302)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    texts = {r["page_id"]: r["text"] for r in html_extract.extract_pages(df).collect()}
    assert all(texts[i] == (f"cell {i}\nmore {i}" if i % 50 == 7 else f"words of {i}") for i in range(200))
    assert texts[200] == "Same here\nwords of 200" and all(texts[i].startswith(f"words of {i} long") for i in (300, 301, 302))
    few = html_extract.read(df.where("page_id < 200").withColumn("host", F.lit("a")))
    articles = ["<nav>n</nav><article><p>one {i}</p>{x}</article>".replace("{x}", x).replace("{i}", str(i)) for i, x in enumerate(["", "<div class=search>s</div>", "<div class=ad>a</div>"])]
    found = [html_extract.settled(html_extract.Page(a, html_extract.Shapes())) for a in articles]
    assert found == ["one 0", None, "one 2"] == [html_extract.extract(articles[0], None), None, html_extract.extract(articles[2], None)]
    assert html_extract.wrappers(few, 8).collect() == html_extract.wrappers(few.repartition(5), 8).collect()


def wrapped(pages):
    import json

    templates = json.dumps(html_extract.induce(sorted(pages)))
    return [html_extract.extract(p, templates) for p in pages]


def test_the_wrapper_finds_the_article_without_any_names():
    """Classes say nothing, no element is made for anything: constant nodes go, links are a menu."""
    page = '<html><body><div class="q1"><div class="q2">The Daily Page</div><div class="q3"><a href="/a">Home</a> <a href="/b">News {i}</a></div></div><div class="q4"><h1>Headline {i}</h1><div class="q5"><p>First words of {i}.</p>{more}</div></div><div class="q6"><p>Call us any time</p><p>No. 1 Street</p></div></body></html>'
    pages = [page.replace("{more}", "<p>And more.</p>" * (i % 3) + f"<p>Of {i}</p>").replace("{i}", str(i)) for i in range(8)]
    for i, text in enumerate(wrapped(pages)):
        assert text == "\n".join([f"Headline {i}", f"First words of {i}.", *["And more."] * (i % 3), f"Of {i}"])
    assert "Call us" in html_extract.extract(pages[0], None)  # that is the wrapper's doing


def test_two_layouts_of_a_host_have_templates_of_their_own():
    first = ["<div class=a><p>fixed one</p></div><div class=b><p>text " + str(i) + "</p></div>" for i in range(4)]
    second = ["<table class=t><tr><td>fixed two</td></tr><tr><td><ul><li>item " + str(i) + "</li><li>b" + str(i) + "</li></ul></td></tr></table>" for i in range(4)]
    assert wrapped(first + second) == [f"text {i}" for i in range(4)] + [f"item {i}\nb{i}" for i in range(4)]


def test_names_alone_take_nothing_out_of_an_article():
    page = '<body class="no-sidebar"><div class="site-header">top</div><article><h1>Head</h1><div class="related-work"><p>kept</p></div><div class="search"><p>kept too</p></div><p>Same on all pages</p><div class="ad">buy</div><aside>x</aside></article><div class="comments">c</div></body>'
    assert html_extract.extract(page, None) == "Head\nkept\nkept too\nSame on all pages"
    own = '<div class="related-work"><p>kept</p></div><div class="search"><p>kept too</p></div>'
    others = [page.replace(own, "").replace("Head", h) for h in ("Other", "Third", "Fourth")]
    assert wrapped([page, *others])[0] == "Head\nkept\nkept too\nSame on all pages"
    assert wrapped([page, *(page.replace("Head", h) for h in "abc")])[0] == "Head\nkept\nSame on all pages"  # a search box on every page
    lead = '<div class="content"><h1>H</h1><div class="body"><p>' + "long text " * 200 + '</p></div><div class="lead">short lead</div></div>'
    assert html_extract.extract(lead, None).startswith("H\nlong") and html_extract.extract(lead, None).endswith("short lead")


def test_copies_of_a_page_keep_their_text():
    page = "<div class=x><p>one</p><p>two</p></div>"
    assert wrapped([page] * 5) == ["one\ntwo"] * 5
    assert wrapped([page, page + "<!-- -->", page + "<!-- - -->"])[0] == "one\ntwo"  # nothing varies: nothing to tell apart


def test_deep_and_wide_pages_take_seconds():
    import time

    began = time.time()
    deep = [f"<div>{k}" * 20_000 + "x" for k in "ab"] + ["<b>" * 50_000 + "y" + "</i>" * 50_000]
    wide = ["<body>" + "".join(f"<p>{i} {k}</p>" if (i * k) % 7 else f"<div class=c{i % 5}>{i}</div>" for i in range(20_000)) + "</body>" for k in (1, 2, 3)]
    found = wrapped(deep + wide)
    assert found[0].count("a") == 20_000 and found[2] == "y" and all(t.count("\n") > 15_000 for t in found[3:])
    assert time.time() - began < 120


def plain_tree_matching(shapes, a, b):
    if shapes.label[a] != shapes.label[b]:
        return 0
    left, right = shapes.kids[a], shapes.kids[b]
    best = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    for i, x in enumerate(left):
        for j, y in enumerate(right):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + plain_tree_matching(shapes, x, y))
    return 1 + best[-1][-1]


def test_alignment_equals_plain_tree_matching():
    r = random.Random(3)

    def tree(depth):
        out = f"<{(tag := r.choice(['div', 'section', 'ul']))} class={r.choice('xy')}>"
        return out + "".join(tree(depth - 1) for _ in range(r.randint(0, 4) if depth else 0)) + f"</{tag}>"

    for _ in range(150):
        shapes = html_extract.Shapes()
        a, b = (html_extract.Page(tree(3), shapes) for _ in "ab")
        pairs = a.tree.pairs(b.tree)
        expected = plain_tree_matching(shapes, a.tree.numbers[0], b.tree.numbers[0])
        assert shapes.match(a.tree.numbers[0], b.tree.numbers[0]) == expected == len(pairs)
        assert all(a.tree.labels[i] == b.tree.labels[j] for i, j in pairs) and len(set(pairs)) == len({i for i, _ in pairs}) == len({j for _, j in pairs})


def test_long_rows_of_children_are_matched_as_well_as_short_ones(monkeypatch):
    r = random.Random(9)
    found = html_extract.Shapes()
    first, others = found.number("p", ()), [found.number("li", ()) for _ in range(1200)]  # paired with the next of its kind, the first row would cost all others
    a, b = found.number("#root", (first, *others)), found.number("#root", (*others, first, found.number("hr", ())))
    assert found.match(a, b) == 1201

    def shape(shapes, depth):
        return shapes.number(r.choice("abc"), tuple(shape(shapes, depth - 1) for _ in range(r.randint(0, 5) if depth else 0)))

    for cells in (1, 4, 30):
        monkeypatch.setattr(html_extract, "CELLS", cells)
        for _ in range(40):
            shapes = html_extract.Shapes()
            a, b = (shapes.number("#root", tuple(shape(shapes, 2) for _ in range(r.randint(1, 12)))) for _ in "ab")
            assert shapes.match(a, b) == plain_tree_matching(shapes, a, b)
            pairs = sorted(shapes.found[a, b][1] or [])
            assert all(i < k and j < m for (i, j), (k, m) in zip(pairs, pairs[1:], strict=False))


# --- 8


def test_languages(documents):
    vocab = {"en": "the of and house water morning window".split(), "de": "der und schön straße fenster nicht weiß".split(), "fr": "été où garçon fenêtre maison là très".split()}
    texts, langs = [], []
    for i in range(120):
        lang = list(vocab)[i % 3]
        texts.append(" ".join(rnd.choice(vocab[lang]) for _ in range(rnd.randint(5, 40))))
        langs.append(lang)
    texts += [None, "", "123 !!", "the of and " * 20_000, texts[0], "ж" * 50]
    langs += [None, "en", "en", None, "en", None]
    docs = documents(texts, langs).withColumn("score", F.lit("x"))
    model = language_id.train(docs.where(~language_id.held_out()))
    found = by_id(language_id.identify(docs, model))
    assert all(found[i]["lang_pred"] == langs[i] for i in range(120))
    assert [found[i]["lang_pred"] for i in (120, 121, 122, 123)] == ["und", "und", "und", "en"]
    assert all(0 <= r["score"] <= 1 for r in found.values()) and found[125]["lang_rejected"]
    assert not any(found[i]["lang_rejected"] for i in range(120))
    empty = language_id.train(documents([]))
    assert by_id(language_id.identify(documents(["a"]), empty))[0]["lang_pred"] == "und"


def test_predictions_equal_plain_cosines(documents):
    """Counts by a dictionary, cosines by sums, the nearest centroid by sorting; ties go to the first language."""
    import numpy as np

    config = language_id.LanguageConfig(bins=64, grams=(1, 2), centroids=2)
    texts = ["der Hund und die Katze", "la maison est là", "the dog, the cat!", "und la the", "ÄÖ ü", "x"]
    model = language_id.train(documents(texts[:3] * 4, ["de", "fr", "en"] * 4), config)

    def plain(text):
        words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
        letters = " " + " ".join(words) + " "
        counts = np.zeros(config.bins)
        for n in config.grams:
            for i in range(len(letters) - n + 1):
                h = 0
                for c in letters[i : i + n]:
                    h = (h * 0x100000001B3 + ord(c)) % 2**64
                counts[((h ^ n) * 0x9E3779B97F4A7C15 % 2**64 >> 40) % config.bins] += 1
        v = np.log1p(counts) * model.idf
        v /= sum(x * x for x in v) ** 0.5
        cosines = [(sum(a * b for a, b in zip(c, v, strict=True)), name) for c, name in zip(model.centroids, model.langs, strict=True)]
        return min(cosines, key=lambda x: (-round(x[0], 12), x[1]))

    found = by_id(language_id.identify(documents(texts), model))
    for i, t in enumerate(texts):
        cosine, name = plain(t)
        assert found[i]["lang_pred"] == name and abs(found[i]["score"] - min(1, max(0, cosine))) < 1e-9
    tied = language_id.LanguageModel(["aa", "bb"], np.stack([model.centroids[0]] * 2), model.idf, {"aa": 0, "bb": 0}, config)
    assert language_id.predict(tied, "der Hund")[0] == "aa"


# --- 9


def test_contamination_equals_brute_force(spark, documents):
    items = [(i, " ".join(rnd.choice(WORDS) for _ in range(n))) for i, n in enumerate([30, 12, 10, 9, 3, 1])] + [(6, None), (7, "!!"), (8, "dup dup dup dup dup dup dup dup dup dup dup dup")]
    texts = [*TEXTS, *[f"{' '.join(rnd.choice(WORDS) for _ in range(20))} {t.upper() if k else t}, {' '.join(rnd.choice(WORDS) for _ in range(20))}" for k in (0, 1) for _, t in items if t], "dup " * 15, items[0][1][:40]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = by_id(decontamination.contamination(documents(texts).withColumn("n_hit", F.lit(1)), bench))
    lower = lambda t: [w for w in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode())]
    windows = defaultdict(set)
    for i, t in items:
        w = lower(t)
        k = min(10, len(w))
        for a in range(len(w) - k + 1 if k else 0):
            windows[tuple(w[a : a + k])].add(str(i))
    for d, t in enumerate(texts):
        w, hit, of = lower(t), set(), set()
        for k in {len(x) for x in windows}:
            for a in range(len(w) - k + 1):
                if tuple(w[a : a + k]) in windows:
                    of |= windows[tuple(w[a : a + k])]
                    hit |= set(range(a, a + k))
        assert (found[d]["n_words"], found[d]["n_hit"], found[d]["item_ids"]) == (len(w), len(hit), sorted(of))
    many = decontamination.test_windows(bench, block_bytes=100)
    assert len(many) > 2  # however the test set is cut into blocks
    assert {d: (r["n_hit"], r["item_ids"]) for d, r in by_id(decontamination.search_index(decontamination.build_index(documents(texts)), many)).items()} == {d: (r["n_hit"], r["item_ids"]) for d, r in found.items()}
    kept = decontamination.without_contaminated(documents(texts), bench)
    assert {r["doc_id"] for r in kept.collect()} == {d for d in found if not found[d]["n_hit"]} and kept.columns == documents([]).columns
    assert decontamination.contamination(documents([]), bench).count() == 0
    assert {r["n_hit"] for r in decontamination.contamination(documents(texts), bench.limit(0)).collect()} == {0}


def test_items_without_an_id_take_no_part(spark, documents):
    bench = spark.createDataFrame([(None, "alpha beta"), ("b", "alpha beta"), ("a", "beta gamma"), ("b", "gamma delta"), (None, "omega")], "item_id string, text string")
    found = by_id(decontamination.contamination(documents(["alpha beta gamma delta", "omega psi", None]), bench))
    assert {d: (r["n_hit"], r["item_ids"]) for d, r in found.items()} == {0: (4, ["a", "b"]), 1: (0, []), 2: (0, [])}
    assert decontamination.without_contaminated(documents(["alpha beta", "omega psi"]), bench).count() == 1
    assert {r["n_hit"] for r in decontamination.contamination(documents(["omega"]), bench.where("item_id is null")).collect()} == {0}


def test_proximity(spark, documents):
    item = "alpha beta gamma delta epsilon"
    docs = documents(["alpha beta gamma delta epsilon", "alpha beta x gamma delta epsilon", "epsilon alpha", "alpha beta gamma delta", "epsilon"])
    blocks = decontamination.test_windows(spark.createDataFrame([(1, item)], "item_id long, text string"))
    index = decontamination.build_index(docs)
    found = decontamination.phrase_matches(index, blocks, slop=1).collect()
    assert {(r["doc_id"], r["exact"]) for r in found} == {(0, True), (1, False)}
    assert [(r["doc_id"], r["start"]) for r in decontamination.phrase_matches(index, blocks).collect()] == [(0, 0)]


def test_proximity_equals_brute_force(spark, documents):
    r = random.Random(5)
    texts = [" ".join(r.choice("abcdefg") for _ in range(r.randint(0, 40))) for _ in range(30)]
    docs, items = documents(texts), [(i, " ".join(r.sample("abcdefg", 3))) for i in range(6)]
    found = decontamination.phrase_matches(decontamination.build_index(docs), decontamination.test_windows(spark.createDataFrame(items, "item_id long, text string"), width=3), slop=1).collect()
    spots = {(x["doc_id"], x["item_id"], x["start"]) for x in found}
    for d, t in enumerate(texts):
        words = t.split()
        for i, item in items:
            near = {s for s in range(-1, len(words) + 1) if all(any(0 <= s + k + g < len(words) and words[s + k + g] == w for g in (-1, 0, 1)) for k, w in enumerate(item.split()))}
            exact = {s for s in range(len(words) - 2) if words[s : s + 3] == item.split()}
            own = {s for x, y, s in spots if (x, y) == (d, str(i))}
            assert exact <= own <= near and bool(own) >= bool(exact)  # a place holds the rarest word at its offset


# --- 10


def components_by_brute_force(texts):
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(fold))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


def edited(text, k):
    words = text.split()
    for _ in range(k):
        words[rnd.randrange(len(words))] = rnd.choice(WORDS)
    return " ".join(words)


def test_near_duplicates_equal_brute_force(documents):
    texts = list(TEXTS)
    for n in (4, 5, 6, 12, 30, 47, 52, 63, 66, 100, 130, 300):
        base = " ".join(rnd.choice(WORDS) for _ in range(n))
        texts += [base, base.upper(), *[edited(base, max(1, round(n * s))) for s in (0.01, 0.02, 0.03, 0.04, 0.05)], base + " tail words here", " ".join(base.split()[n // 6 :])]
    passage = " ".join(rnd.choice(WORDS) for _ in range(60))
    texts += [f"{' '.join(rnd.choice(WORDS) for _ in range(rnd.randint(10, 200)))} {passage}" for _ in range(40)]
    hub = " ".join(rnd.choice(WORDS) for _ in range(120))
    texts += [hub, *[edited(hub, 3) for _ in range(60)]]
    docs = documents(texts).withColumn("cls", F.lit("clash"))
    sizes, expected = components_by_brute_force(texts)
    found = by_id(jaccard_join.near_duplicate_classes(docs))
    assert [found[i]["n_shingles"] for i in range(len(texts))] == sizes
    assert [found[i]["component_id"] for i in range(len(texts))] == expected
    kept = sorted(r["doc_id"] for r in jaccard_join.without_near_duplicates(docs).collect())
    assert kept == [i for i in range(len(texts)) if expected[i] == i]


def test_hot_signatures_change_no_result(documents, monkeypatch):
    """Signatures dealt to all tasks, and rows passed on in pieces, as of a boilerplate that very many share."""
    shared = " ".join(rnd.choice(WORDS) for _ in range(40))
    texts = [f"{shared} {' '.join(rnd.choice(WORDS) for _ in range(rnd.randint(1, 30)))}" for _ in range(60)]
    sizes, expected = components_by_brute_force(texts)
    monkeypatch.setattr(jaccard_join, "SAMPLED", 1)
    found = by_id(jaccard_join.near_duplicate_classes(documents(texts), hot=5))
    assert [(found[i]["n_shingles"], found[i]["component_id"]) for i in range(len(texts))] == list(zip(sizes, expected, strict=True))


def test_saturated_signatures_keep_all_classes(spark):
    import numpy as np
    import pyarrow as pa

    assert jaccard_join.HOT == 32 and not (jaccard_join.band_signatures(np.arange(9, dtype=np.uint64))[0][2] & np.uint64(32)).any()
    rows = [(64, c) for c in range(50)] + [(128, 1), (128, 2), (128, 2), (192, 7)] + [(256 | 32, c) for c in range(9)]
    keyed = spark.createDataFrame(rows, "key long, cls long")
    told = spark.sparkContext.broadcast((np.array([256]), np.array([77])))
    found = {(r["key"], r["cls"]): r["sharing"] for r in jaccard_join.shared_signatures(keyed, 3, told).collect()}
    assert found == {**{(64, c): 50 for c in range(50)}, (128, 1): 2, (128, 2): 2, **{(288, c): 77 for c in range(9)}}


def test_near_duplicates_of_empty_tables_and_repeated_ids(documents):
    assert jaccard_join.near_duplicate_classes(documents([])).count() == 0
    docs = documents(["a b c d e f g", None])
    twice = docs.unionByName(docs)
    assert sorted(r["component_id"] for r in jaccard_join.near_duplicate_classes(twice).collect()) == [0, 0, 1, 1]
    assert sorted(r["doc_id"] for r in jaccard_join.without_near_duplicates(twice).collect()) == [0, 1, 1]


def test_rows_of_one_id_are_judged_by_their_own_texts(spark):
    a, b, c = ("one two three four five six", "seven eight nine ten eleven", "a b c d e f g h")
    rows = [(1, a, "x"), (1, b, "y"), (2, b, "z"), (3, a, "w"), (None, a, "v"), (None, c, "u"), (None, c, "u2"), (4, "", "e"), (4, b, "f"), (5, None, "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, cls string").withColumns({"row": F.lit(1), "stays": F.lit(2), "component_id": F.lit(3), "odd_id": F.lit(4)})
    kept = jaccard_join.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    # of each text the row with the smallest id, of the null ids' own text one of the two, and all without words
    found = sorted(r["cls"] for r in kept.collect())
    assert found in (["e", "g", "u", "x", "y"], ["e", "g", "u2", "x", "y"])


def test_hamming_never_exceeds_the_difference():
    import numpy as np

    r = np.random.default_rng(3)
    for _ in range(200):
        common = r.integers(0, 1 << 63, r.integers(1, 300), dtype=np.uint64)
        a, b = (np.unique(np.concatenate([common, r.integers(0, 1 << 63, r.integers(0, 60), dtype=np.uint64)])) for _ in "ab")
        x, y = (np.array(jaccard_join.parity_sketch(s), np.int64) for s in (a, b))
        while len(x) != len(y):
            x, y = (x, y[: len(y) // 2] ^ y[len(y) // 2 :]) if len(y) > len(x) else (x[: len(x) // 2] ^ x[len(x) // 2 :], y)
        assert np.bitwise_count((x ^ y).view(np.uint64)).sum() <= len(set(a.tolist()) ^ set(b.tolist()))
