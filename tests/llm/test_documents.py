"""Packing, splitting and leaks: exact round trips and brute force on small texts."""

import os
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm.leaks import COMMON, NAME, NUMBER, TYPED, UNIT, Rules, Vocabulary, distance, document_windows, folded, item_windows, leaks, vocabulary_of
from tidemark.llm import packing
from tidemark.llm.packing import pack_documents, pack_shard
from tidemark.llm.splitting import BLOCK_WORDS, boundaries, cohesion, rank_file_tokens, split_documents, split_text, words_of

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def documents(spark, rows):
    """rows: (id, source, text); other columns have the names that operators use inside."""
    return spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "1 doc", "'s' shard", "2 tokens", "3 container", "4 piece", "'w' words")


# --- packing


def test_every_token_once_in_containers_of_their_size(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice(["hot", "hot", "a", "b", None, ""]), "x" * rng.choice([0, 1, 50, 99, 100, 101, 250, rng.randrange(100)])) for k in range(600)]
    rows += [(7, "a", "y" * 30), (7, "a", "y" * 30), (None, "a", "z" * 130), (900, "b", None), (2**62 + 1, "b", "w" * 40)]
    got = pack_documents(documents(spark, rows), capacity=100, shards=5).collect()
    load, slots, parts = defaultdict(int), defaultdict(list), defaultdict(list)
    for r in got:
        load[r["container"]] += r["n_tokens"]
        slots[r["container"]].append(r["position"])
        parts[r["doc"], r["source"]].append((r["piece"], r["start_token"], r["n_tokens"]))
    assert max(load.values()) <= 100
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = defaultdict(list)
    for doc, source, text in rows:
        n = len(text or "")
        want[doc, source] += [(p, s, min(100, n - s)) for p, s in enumerate(range(0, n, 100))]
    assert {k: sorted(v) for k, v in parts.items()} == {k: sorted(v) for k, v in want.items() if v}
    assert sum(load.values()) / 100 / len(load) > 0.9


def test_containers_do_not_depend_on_the_order_of_rows(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice("abc"), "x" * rng.randrange(1, 150)) for k in range(200)]
    one = pack_documents(documents(spark, rows), capacity=100, shards=3).collect()
    rng.shuffle(rows)
    assert sorted(one) == sorted(pack_documents(documents(spark, rows).repartition(7), capacity=100, shards=3).collect())


def test_containers_do_not_depend_on_the_session(spark, monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(packing, "SHARD", 300)
    df = documents(spark, [(k, rng.choice("abc"), "x" * rng.randrange(1, 150)) for k in range(1000)])
    got = []
    was = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 8, 200):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got.append(sorted(pack_documents(df, capacity=200).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert got[0] == got[1] == got[2] and len({r["container"] >> 32 for r in got[0]}) == 4
    load = defaultdict(int)
    for r in got[0]:
        load[r["container"]] += r["n_tokens"]
    assert sum(load.values()) / 200 / len(load) > 0.97


@pytest.mark.parametrize("n_sources", [2, 30])
def test_windows_keep_the_mixture(n_sources):
    """Total variation of each whole window from the shares of all, and how full the containers are."""
    rng = random.Random(3)
    names = [None, *(f"s{k}" for k in range(n_sources - 1))]
    weight = [1 / (k + 1) for k in range(n_sources)]
    sizes = [min(6000, int(rng.lognormvariate(7.4, 1)) + 1) for _ in range(12_000)]
    items = [(k, s, 0, 0, n) for k, (s, n) in enumerate(zip(rng.choices(names, weight, k=12_000), sizes, strict=True))]
    window = 320
    packed = pack_shard(items, 6000, window)
    assert sorted(x[3] for x in packed) == list(range(12_000))
    total, every = defaultdict(float), sum(sizes)
    for _, s, _, _, n in items:
        total[s] += n / every
    for w in range(packed[-1][0] // window):
        seen = defaultdict(float)
        for c, _, at, _, s, _, _, n in packed:
            if at == w:
                seen[s] += n
        assert sum(abs(seen[s] / sum(seen.values()) - total[s]) for s in names) / 2 < 0.05
    assert every / 6000 / (packed[-1][0] + 1) > 0.99


def test_nothing_to_pack(spark):
    assert pack_documents(documents(spark, [(1, "a", "x")]).limit(0)).count() == 0


# --- splitting


def check_pieces(text, pieces, limit, overlap, ends=None):
    raw = text.encode()
    ends = np.arange(1, len(raw) + 1) if ends is None else ends
    assert pieces[0][:1] == (0,) and pieces[-1][1] == len(raw)
    for a, b, s, e in pieces:
        assert 0 < e - s <= limit and b == ends[e - 1]
        if ends is None:
            raw[a:b].decode()
    for (_, b, _, e), (a2, _, s2, _) in zip(pieces, pieces[1:], strict=False):
        assert overlap <= e - s2 <= overlap + 3 and a2 <= b


@pytest.mark.parametrize("text", ["word " * 500, "a" * 3000, "é" * 1500, "😀" * 800, "\n" * 2500, "one line of words\n" * 150, "PARA.\n\nsome words here\n\n" * 120, "x" * 999 + " " + "y" * 2000])
@pytest.mark.parametrize("overlap", [0, 30, 200])
def test_pieces_cover_the_text(text, overlap):
    pieces = split_text(text, 700, overlap)
    check_pieces(text, pieces, 700, overlap)
    raw = text.encode()
    for a, b, *_ in pieces:
        raw[a:b].decode()


def test_the_best_boundary_is_taken():
    line = "some words of a line\n"
    text = (line * 12 + "\n") * 12
    ends = [b for _, b, *_ in split_text(text, 900, 50)][:-1]
    assert all(text[b - 2 : b] == "\n\n" for b in ends)
    words = "word " * 600
    assert all(words[b - 1] != " " and words[b] == " " for _, b, *_ in split_text(words, 900, 50)[:-1])
    article = "lower case words.\n" * 14 + "\nA HEADLINE\n" + "other words now\n" * 60 + "\n" + "other words now\n" * 60
    assert article[split_text(article, 450, 20)[0][1] :].startswith("A HEADLINE")


def test_a_change_of_topic_is_preferred():
    rng = random.Random(5)
    about = lambda words, n: [" ".join(rng.choice(words) for _ in range(8)) for _ in range(n)]
    lines = about(["anchor", "harbour", "vessel", "captain"], 17) + about(["kettle", "butter", "kitchen", "pepper"], 30)
    text = "\n".join(lines) + "\n"
    cut = split_text(text, 1400, 100)[0][1]
    assert cut == len("\n".join(lines[:17])) + 1


def test_cohesion_is_the_cosine_of_the_blocks():
    rng = np.random.default_rng(1)
    ids = rng.integers(-1, 12, 150)
    got = cohesion(ids, BLOCK_WORDS)
    for g in range(0, 151, 7):
        left, right = ids[max(0, g - BLOCK_WORDS) : g], ids[g : g + BLOCK_WORDS]
        a, b = (np.array([(x == i).sum() for i in range(12)]) for x in (left, right))
        norm = np.sqrt(max(1, a @ a) * max(1, b @ b))
        assert got[g] == pytest.approx(a @ b / norm)


def test_words_and_boundaries_of_odd_texts():
    for text in ("", " ", "\n", "a", "a b"):
        raw = np.frombuffer(text.encode(), np.uint8)
        start, end, h = words_of(raw)
        assert [text[a:b] for a, b in zip(start, end, strict=True)] == text.split() and len(h) == len(start)
        boundaries(raw, text.encode())
    raw = np.frombuffer(b"Word word other", np.uint8)
    h = words_of(raw)[2]
    assert h[0] == h[1] != h[2]


def test_split_documents(spark):
    long = "Some words of a long text, that go on.\n" * 400
    df = documents(spark, [(1, "a", long), (2, "a", "short"), (3, "a", "x" * 6000), (4, "a", "x" * 6001), (None, "b", "ü" * 3001), (5, "a", None), (6, "a", ""), (1, "a", long)])
    big = 2**62 + 1  # beside a NULL id
    assert {r["doc"] for r in split_documents(documents(spark, [(big, "a", long), (None, "b", long)])).collect()} == {big, None}
    got = split_documents(df).toPandas()
    assert got.groupby("doc", dropna=False).size().to_dict().keys() >= {1, 4}
    assert sorted(set(got.doc.dropna())) == [1, 4] and got.doc.isna().any()
    one = got[got.doc == 1].sort_values(["piece"])
    assert (one.groupby("piece").size() == 2).all()
    assert (got.text.map(lambda t: len(t.encode())) == got.end_token - got.start_token).all()
    assert split_documents(df.limit(0)).count() == 0
    huge = spark.createDataFrame([(1, "line of words\n" * 300_000)], "doc_id long, text string")
    assert split_documents(huge).agg(F.max("end_token")).first()[0] == 14 * 300_000


@pytest.mark.skipif(not os.path.exists(RANKS), reason="needs the vocabulary")
def test_tokens_of_a_vocabulary(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    text = "The harbour was rebuilt; naïve Grüße 😀 are here.\n" * 60
    pattern = public_tokenizers.PATTERN
    ends = rank_file_tokens(RANKS, pattern)(text)
    pieces = split_text(text, 200, 20, lambda _: ends)
    assert pieces[-1][3] == len(ends) and ends[-1] == len(text.encode())
    for (_, _, _, e), (_, _, s2, _) in zip(pieces, pieces[1:], strict=False):
        assert 20 <= e - s2 <= 24
    got = split_documents(spark.createDataFrame([(1, text), (2, "few")], "doc_id long, text string"), limit=200, overlap=20, rank_file=RANKS, pattern=pattern)
    assert got.count() == len(pieces)


# --- leaks

NOUNS = ["harbour", "kettle", "violin", "granary"] + [a + b for a in "bram chol dern fusk gilt harn jurb kest lorm mund pell rast sind tarv".split() for b in "ock and een ister owel ipan umber athe".split()]
VERBS = [a + "ed" for a in "mend prais rebuild water christen flood plough light hoist varnish polish carv bak brew tann graft".split()]
NAMES = "Grunmouth Tordale Zelbury Harwick Oststead Fenholm Marcliffe Culgate".split()


def passage(rng, sentences):
    out = []
    for _ in range(sentences):
        a, b, c = rng.sample(NOUNS, 3)
        out.append(rng.choice([f"The {a} at {rng.choice(NAMES)} was {rng.choice(VERBS)} since the {b} {rng.choice(VERBS)} its {c}.", f"{rng.randrange(2, 2000)} visitors {rng.choice(VERBS)} the {a}, while the {b} {rng.choice(VERBS)} the {c}."]))
    return " ".join(out)


def lines(text, width, sep="\n"):
    out, line = [], ""
    for w in text.split():
        if len(line) + len(w) > width:
            out.append(line.strip())
            line = ""
        line += w + " "
    return sep.join([*out, line.strip()])


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(9)
    items = [(k, passage(rng, 8) + " What does the passage say?") for k in range(40)]
    items.append((40, items[3][1].replace("What does the passage say?", "Why was it said?")))
    words = lambda k: items[k][1].split()
    noise = lambda: passage(rng, 6)
    docs, want = [], set()

    def add(text, *leaked):
        docs.append((len(docs), "s", text))
        want.update((len(docs) - 1, k) for k in leaked)

    for k in range(20):
        add(lines(noise(), 40))
    add(lines(noise() + " " + " ".join(words(5)[10:35]) + " " + noise(), 40), 5)
    add(lines(" ".join(words(5)[10:27]) + " " + noise(), 40))  # seventeen words
    add(lines(noise() + " " + items[3][1] + noise(), 30), 3, 40)
    add(lines(" ".join(words(7)[:40]), 30).upper().replace(".", ""), 7)
    broken = lines(" ".join(words(8)[:45]).replace("the", "tbe", 2).replace("rn", "m").replace("violin", "vi0lin").replace("ee", "éé"), 28)
    add(noise() + "\n" + broken.replace("mea", "mea-\n").replace("lant", "lant ¬\n"), 8)
    part = words(9)[:60]
    add(" ".join(part[:30]) + "\nFINEST COAL AND BUTTER, 1952d. PER DOZEN\nAPPLY MARNOOK, 16 QUAY STREET\n" + " ".join(part[30:]), 9)
    swapped = [w if k % 5 else rng.choice(NOUNS) for k, w in enumerate(words(11)[:60])]
    add(lines(" ".join(swapped), 40))  # every fifth word is another
    add(lines(" ".join(NAMES[NAMES.index(w.strip(".,")) - 3] if w.strip(".,") in NAMES else str(int(w) * 7 + 11111) if w.isdigit() else w for w in words(12)), 40))
    return items, docs, want


def test_leaks_are_found_through_damage(spark, corpus):
    items, docs, want = corpus
    it = spark.createDataFrame([*items, (99, None), (98, "")], "item_id long, text string")
    odd = [(1000, "s", None), (1001, "s", ""), (1002, "s", "word " * 200_000), (None, "s", docs[22][2]), docs[20]]
    got = leaks(documents(spark, docs + odd), it).collect()
    found = sorted((r["doc"], r["item"]) for r in got if r["leaked"] and r["doc"] is not None)
    assert found == sorted([*want, (20, 5)])
    assert {r["item"] for r in got if r["doc"] is None and r["leaked"]} == {3, 40}
    assert any(r["doc"] == 27 and r["item"] == 12 and not r["leaked"] for r in got)  # the template with other values


def test_passages_without_template_words_are_found(spark):
    rng = random.Random(4)
    names = ["".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(4)).title() for _ in range(60)]
    it = spark.createDataFrame([(1, "Among the guests were " + ", ".join(names) + "."), (2, passage(rng, 8))], "item_id long, text string")
    printed = passage(rng, 4) + " " + ", ".join(names[10:40]) + " " + passage(rng, 4)
    other = passage(rng, 4) + " " + ", ".join(rng.sample(names, 60)) + " " + passage(rng, 4)
    got = leaks(documents(spark, [(1, "s", lines(printed, 30)), (2, "s", lines(other, 30))]), it)
    assert [tuple(r) for r in got.where("leaked").collect()] == [(1, 1, 30, True, 30, 0)]


def test_a_leak_damaged_throughout_is_aligned(spark, corpus):
    items, _, _ = corpus
    damaged, n = "", 0  # every thirteenth letter is another
    for c in " ".join(items[13][1].split()[:40]):
        n += c.isalnum()
        damaged += "x" if c.isalnum() and n % 13 == 0 else c
    it = spark.createDataFrame(items, "item_id long, text string")
    got = {r["item"]: r["words"] for r in leaks(documents(spark, [(1, "s", lines(damaged, 40))]), it).collect()}
    assert got[13] >= 30


def test_rows_depend_on_the_tables_alone(spark, corpus):
    items, docs, want = corpus
    it = spark.createDataFrame(items, "item_id long, text string")
    got = [sorted(leaks(documents(spark, docs).repartition(n), it.repartition(n)).collect()) for n in (1, 4, 40)]
    assert got[0] == got[1] == got[2]
    assert {(r["doc"], r["item"]) for r in got[0] if r["leaked"]} == want


def near(rng, w):
    """A number or name that is one digit or letter off."""
    k = rng.randrange(1, len(w))
    return w[:k] + rng.choice([c for c in ("123456789" if w.isdigit() else "abdegkmprt") if c != w[k]]) + w[k + 1 :]


def test_reparameterised_items_are_no_leaks(spark):
    """Of sixty items each is printed once, damaged, and once with every number and name a little different."""
    rng = random.Random(17)
    place = lambda: "".join(rng.choice(["Brun", "Dov", "Kes", "Lor", "Mar", "Nar", "Os", "Pel", "Ruf", "Tes"]) + rng.choice(["a", "e", "i", "o"]) for _ in range(2)) + rng.choice(["mouth", "dale", "bury", "wick"])
    items, docs = [], []
    for k in range(60):
        out = [f"In {place()} {rng.randrange(1200, 9999)} visitors {rng.choice(VERBS)} the {rng.choice(NOUNS)} while the {rng.choice(NOUNS)} of {place()} {rng.choice(VERBS)} {rng.randrange(1200, 9999)} days." for _ in range(4)]
        items.append((k, " ".join(out)))
        as_is = "".join(c if rng.random() > 0.01 or not c.isalpha() else "x" for c in " ".join(out[1:3]))
        other = [near(rng, w) if w.isdigit() or (w[0].isupper() and w != "In") else w for w in items[k][1].split()]
        docs += [(2 * k, "s", lines(passage(rng, 3) + " " + as_is + " " + passage(rng, 3), 40)), (2 * k + 1, "s", lines(passage(rng, 3) + " " + " ".join(other), 40))]
    it = spark.createDataFrame(items, "item_id long, text string")
    got = leaks(documents(spark, docs), it).collect()
    leaked = {(r["doc"], r["item"]) for r in got if r["leaked"]}
    assert leaked == {(2 * k, k) for k in range(60)}
    told = {(r["doc"], r["item"]) for r in got if not r["leaked"] and r["n_other"] >= 3 and r["n_other"] * 2 > r["n_slots"]}
    assert told >= {(2 * k + 1, k) for k in range(60)} and len(told) <= 62


def test_placeholders_are_part_of_the_windows():
    known = {"harbour": 0, "kettle": 1, "mended": 2, "tordale": 3, "crowns": UNIT, "the": COMMON}
    v = Vocabulary(known, 3)
    words = "the harbour tordale mended 1718 kettle crowns".split()
    windows = item_windows(words, v)
    _, place, key, every, slots = document_windows(["the harbour zelbury mended the 1719 kettle crowns".split()], v, 16)
    met = {(k, p): s for k, p, s, sort in windows if sort == TYPED}
    # The same template with another name and number: the keys meet, the slots tell them apart.
    joined = [(met[k, 1], "".join(every[x] for x in row if x >= 0)) for k, row in zip(key.tolist(), slots.tolist(), strict=True) if (k, 1) in met]
    assert ("tordale", "zelbury") in joined
    # Kinds are told apart in the keys, and without placeholders other windows are left.
    one = lambda kind: v.windows(np.array([[0, kind, 2]]))[1][0]
    assert len({one(k) for k in (NUMBER, NAME, UNIT)}) == 3
    bare = Vocabulary(known | dict.fromkeys(["tordale", "zelbury", "1718", "1719", "crowns"], COMMON), 3)
    assert {k for k, *_ in item_windows(words, bare)} != {k for k, *_ in windows}
    # Fewer than two template words: the name itself is in the key.
    good, _, _, filled = v.windows(np.array([[0, 3, NUMBER], [0, NAME, NUMBER]]))
    assert good.tolist() == [True, False] and filled.tolist() == [True, False]


def test_nothing_to_search(spark, corpus):
    items, docs, _ = corpus
    it = spark.createDataFrame(items, "item_id long, text string")
    assert leaks(documents(spark, docs), it.limit(0)).count() == 0
    assert leaks(documents(spark, docs).limit(0), it).count() == 0


def test_folding():
    assert folded("Straße, gem -\neldet, res¬\npect, é") == "strasse, gemeldet, respect, e"


def test_distance_is_that_of_levenshtein():
    code = lambda s: np.frombuffer(s.encode(), np.uint8)
    for a, b, n in (("", "", 0), ("abc", "", 3), ("kitten", "sitting", 3), ("the", "again", 5)):
        assert distance(code(a), code(b)) == distance(code(b), code(a)) == n


def test_words_by_kind_and_damaged_ones(spark):
    texts = ["the harbour and the kettle in May", "the lantern and the meadow of Tordale for 5 taler", "then 7 taler and the rest", "all the 9 taler and more"]
    v = vocabulary_of(spark.createDataFrame([(t, None) for t in texts], "text string, lang string"), Rules())
    assert v["harbour"] == v["harb0ur"] == v["harbonr"] == v["harbor"] == v["harrbour"] >= 0
    assert v["harbour"] < v.templates <= v["tordale"]
    assert (v["1950"], v["taler"], v["zelbury"], v["the"], v["xq"]) == (NUMBER, UNIT, NAME, COMMON, COMMON)
