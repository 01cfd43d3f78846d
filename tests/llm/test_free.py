"""Token files, mixing, vectors, language id, chat windows, near duplicates, the pipeline."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from reclink.llm import chat_windows, langid, mixing, near_dups, queries, token_files, vector_tree
from reclink.llm.components import components

SF = "/root/testdata/sf0.001"
ODD = ["", " ", "plain text", "Ünïcödé  text\twith\x0bspaces and more", "<|endoftext|> a<|startoftext|>b", "it's we'll 12345 !!!", "\n\n\n",
       "é ΣΑΣ Σ", "𝒳𝒴 emoji 🎉🎉", "x" * 5000, None]


# --- token files


@pytest.mark.parametrize("words", [True, False])
def test_token_files_round_trip(spark, tmp_path, words):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(queries.tokenizer_file())
    rows = [(i * 3 % 41, t, "x") for i, t in enumerate(ODD * 4)] + [(None, "no id", "x"), (None, None, "x"), (5, "long " * 60000, "x")]
    out = str(tmp_path / f"t{words}")
    m = token_files.write_tokens(spark.createDataFrame(rows, "doc_id long, text string, start string"), out, queries.tokenizer_file(), words=words, parts=5)
    assert sum(r["docs"] for r in m.collect()) == len(rows)
    got = sorted(token_files.read_tokens(spark, out, batch_tokens=500).collect(), key=lambda r: (r["start"]))
    assert [r["start"] for r in got] == [sum(x["n_tokens"] for x in got[:i]) for i in range(len(got))]
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x))
    want = collections.Counter((i, np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes()) for i, t, _ in rows)
    assert collections.Counter((r["doc_id"], bytes(r["ids"])) for r in got) == want


def test_words_encoded_alone_give_the_ids_of_whole_texts():
    """Every code point before and after a point and a comma."""
    with open(queries.tokenizer_file(), encoding="utf-8") as f:
        spec = f.read()
    fast, whole = token_files.Encoder(spec, True, "<u4"), token_files.Encoder(spec, False, "<u4")
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isprintable() or c in (9, 10, 0x307, 0x300)]
    texts = ["".join(f"a{chr(c)}. b{chr(c)}, {chr(c)}.\n" for c in points[a:a + 500]) + f"z{chr(points[a])}." for a in range(0, len(points), 500)]
    assert fast.encode(texts) == whole.encode(texts)


def test_token_files_empty(spark, tmp_path):
    out = str(tmp_path / "none")
    token_files.write_tokens(spark.createDataFrame([], "doc_id long, text string"), out, queries.tokenizer_file())
    assert token_files.read_tokens(spark, out).count() == 0


def test_token_files_wide_ids(spark, tmp_path):
    out = str(tmp_path / "wide")
    m = token_files.write_tokens(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), out, queries.tokenizer_file(), end_id=70000)
    assert m.first()["dtype"] == "<u4" and np.frombuffer(token_files.read_tokens(spark, out).first()["ids"], "<u4")[-1] == 70000


# --- mixing


def check_pfair(weights, slots):
    total, seen = sum(weights.values()), collections.Counter()
    for n, (s, k, slot, release, deadline) in enumerate(mixing.schedule(weights, slots)):
        assert n == slot and release <= slot < deadline and k == seen[s]
        seen[s] += 1
        if slot % 7 == 0 or slot > slots - 100:
            assert all(abs(seen[x] - w / total * (slot + 1)) < 1 for x, w in weights.items())
    assert sum(seen.values()) == slots


def test_schedule_is_pfair_for_the_given_weights():
    check_pfair({"a": 0.5, "b": 0.31, "c": 0.1, None: 0.09}, 3000)
    check_pfair(mixing.temper({"a": 700_000, "b": 200_000, "c": 99_000, "d": 900, "e": 100}, 0.8), 1_000_000)
    check_pfair(mixing.temper({i: random.Random(i).randint(1, 10 ** 6) for i in range(60)}, 0.7), 20_000)
    assert list(mixing.schedule({}, 0)) == []


def test_mix_places_every_row(spark):
    rng = random.Random(0)
    rows = [(i, f"t{i}", "hot" if i % 3 == 0 else rng.choice(["a", "b", None]), -1) for i in range(2000)] + [(None, None, "a", -1)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, slot int")
    weights = mixing.temper(mixing.source_counts(df), 0.5)
    got = mixing.mix(df, weights, max_blocks=700, bucket_rows=100).collect()
    size = 1 + max(r["pos"] for r in got if r["slot"] == 0)  # documents a block, chosen for 700 blocks
    assert size > 1
    assert sorted(r["pos"] for r in got) == list(range(len(got)))
    assert {(r["row"]["doc_id"], r["row"]["text"]) for r in got} == {(r[0], r[1]) for r in rows}
    assert all(r["release"] <= r["slot"] < r["deadline"] and r["pos"] // size == r["slot"] for r in got)
    by_slot = {r["slot"]: r["source"] for r in got}
    seen = collections.Counter()
    for t in range(max(by_slot) + 1):
        seen[by_slot[t]] += 1
        assert all(abs(seen[s] - w * (t + 1)) < 1 for s, w in weights.items())
    times = collections.Counter((r["source"], r["row"]["doc_id"], r["row"]["text"], r["epoch"]) for r in got)
    assert max(v for k, v in times.items() if k[1] is not None) == 1


def test_mix_empty_and_missing_weight(spark):
    df = spark.createDataFrame([(1, "x", "s")], "doc_id long, text string, source string")
    assert mixing.mix(df.limit(0), {}).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(df, {"other": 1.0})
    with pytest.raises(ValueError):
        mixing.mix(df.union(df.withColumn("source", F.lit("t"))), {"s": 1.0, "t": 1e-12})


# --- vectors


def plain_search(rows, k):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = {}
    for q, x in ok:
        if q % 50 == 0:
            best = {}
            for i, y in ok:
                if i != q:
                    s = float(vector_tree.cosines(y[None], x[None])[0])
                    best[i] = max(best.get(i, -9), s)
            out[q] = sorted(best.items(), key=lambda t: (-t[1], t[0]))[:k]
    return out


def run_search(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 0.0) for i, v in rows], "vec_id long, embedding array<float>, score double")
    got = collections.defaultdict(list)
    for r in sorted(vector_tree.search(df, F.col("vec_id") % 50 == 0, **options).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    return dict(got)


def test_vectors_odd_rows_and_ties(spark):
    rng = np.random.RandomState(0)
    rows = [(i, rng.randn(8).astype("float32").tolist()) for i in range(120)]
    rows += [(200 + i, rows[3][1]) for i in range(300)]  # one very common vector
    rows += [(600, None), (601, []), (602, [0.0] * 8), (603, [float("nan")] * 8), (604, [None] + [1.0] * 7), (650, [float("inf")] * 8), (None, rows[5][1]), (50, rows[50][1])]
    got, want = run_search(spark, rows, recall=1.0, leaf_rows=20, cell_rows=50, block=2), plain_search(rows, 5)
    assert got.keys() == want.keys()
    for q in want:
        assert [x[0] for x in got[q]] == [x[0] for x in want[q]] and np.allclose([x[1] for x in got[q]], [x[1] for x in want[q]], atol=1e-15)


def test_vectors_repeated_ids_and_lengths(spark):
    rng = np.random.RandomState(1)
    vec = lambda n=4: rng.randn(n).astype("float32").tolist()
    same = vec()
    rows = [(1, same)] * 8 + [(50, same)] + [(i, vec()) for i in range(2, 8)]  # equal rows of one id
    rows += [(9, [x * (1 + 0.01 * j) for x in same[:3]] + [same[3] + 0.001 * j]) for j in range(9)]  # many different rows of one id
    rows += [(100, vec(2)), (101, vec(2)), (102, vec(2)), (150, vec(3))]  # other lengths
    got, want = run_search(spark, rows, recall=1.0), {q: w for q, w in plain_search_by_length(rows, 5).items() if w}
    assert {q: [x[0] for x in r] for q, r in got.items()} == {q: [x[0] for x in r] for q, r in want.items()}


def plain_search_by_length(rows, k):
    out = {}
    for n in {len(v) for _, v in rows}:
        out |= plain_search([r for r in rows if len(r[1]) == n], k)
    return out


def test_vectors_few_rows(spark):
    assert run_search(spark, [(0, [1.0, 0.0])]) == {}
    got = run_search(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [2.0, 2.0])])
    assert [x[0] for x in got[0]] == [2, 1]
    assert run_search(spark, []) == {}


def test_vectors_recall(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    got, want = run_search(spark, rows), plain_search(rows, 5)
    hits = sum(len({x[0] for x in got[q]} & {x[0] for x in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))


# --- language id


def test_language_held_out_accuracy(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = queries.op6_language(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(truth) and all(0 <= r["score"] <= 1 for r in got)
    out = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in out} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in out]) > 0.98


def test_language_odd_inputs(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog", "en", "x"), (2, "der hund und die katze", "de", "x"), (3, "le chat et le chien", "fr", "x"), (4, None, "en", "x"),
                                  (5, "123 !!", "en", "x"), (6, "", None, "x"), (7, "le chien " * 40000, None, "x"), (7, "le chien " * 40000, None, "x"), (None, "und der hund", None, "x")],
                                 "doc_id long, text string, lang string, lang_pred string")
    model = langid.train(docs)
    got = [(r["row"]["doc_id"], r["lang_pred"], r["score"]) for r in langid.predict(docs, model).collect()]
    assert len(got) == 9 and model.families == {"germanic": ["de", "en"], "romance": ["fr"]}
    by = dict((g[0], g[1]) for g in got)
    assert by == {1: "en", 2: "de", 3: "fr", 4: "und", 5: "und", 6: "und", 7: "fr", None: "de"}
    assert all(s == 0 for i, p, s in got if p == "und")
    assert langid.predict(docs.limit(0), model).count() == 0
    untaught = langid.train(docs.where("lang = 'xx'"))
    assert {r["lang_pred"] for r in langid.predict(docs, untaught).collect()} == {"und"}
    single = langid.train(docs.where("lang = 'fr'"))
    assert {r["lang_pred"] for r in langid.predict(docs.where("doc_id = 1"), single).collect()} == {"fr"}


def test_language_of_copies_is_learned(spark, monkeypatch):
    text = {"en": lambda i: f"the cat and the dog number {i}", "de": lambda i: f"der hund und die katze nummer {i}"}
    rows = [(text["en"](i), "en") for i in range(2000)] + [(text["de"](i % 5), "de") for i in range(20000)]
    seen = []
    monkeypatch.setattr(langid, "Model", lambda x, langs: seen.append(collections.Counter(langs)) or len({v.tobytes() for v in x}))
    assert langid.train(spark.createDataFrame(rows, "text string, lang string"), max_per_lang=40) == 45
    assert seen == [{"de": 5, "en": 40}]


def test_numerals_are_no_letters(spark):
    assert not any(map(langid.has_letter, [None, "", "½ ² Ⅷ ③ 12 _", "-" * 100_000])) and langid.has_letter("½é")
    model = langid.Model(np.stack([langid.features("the cat")]), ["en"])
    got = langid.predict(spark.createDataFrame([(1, "½ ² Ⅷ"), (2, "a")], "doc_id long, text string"), model).collect()
    assert [(r["lang_pred"], r["score"] > 0) for r in got] == [("und", False), ("en", True)]


def test_svm_and_votes_equal_plain_python():
    """The weights meet the dual's optimality conditions, and a prediction is the vote over all pairs."""
    rng = np.random.RandomState(0)
    x, y = rng.randn(60, 5), np.where(rng.rand(60) < 0.4, 1, -1)
    x[y > 0] += 1.0
    w, c = langid.svm(x, y, passes=3000), 10.0
    xb = np.hstack([x, np.ones((60, 1))])
    cap = np.where(y > 0, c * 60 / (2 * (y > 0).sum()), c * 60 / (2 * (y < 0).sum()))
    value = lambda v: 0.5 * v @ v + (cap * np.maximum(0, 1 - y * (xb @ v))).sum()
    assert all(value(w) <= value(w + 0.02 * rng.randn(6)) + 1e-6 for _ in range(300))
    langs = ["en", "de", "nl", "fr", "es"]
    texts = [(lang, " ".join(random.Random(f"{lang}{i}").choices([lang * 2, lang + "x", "common"], k=12))) for lang in langs for i in range(6)]
    f = np.stack([langid.features(t) for _, t in texts])
    model = langid.Model(f, [lang for lang, _ in texts])
    got, _ = model.predict(f)
    for v, g in zip(np.hstack([f, np.ones((len(f), 1), f.dtype)]), got):
        fam = max(model.over, key=lambda k: v @ model.over[k])
        group = model.families[fam]
        wins = {a: (sum((v @ model.pairs[a, b] > 0) if (a, b) in model.pairs else (v @ model.pairs[b, a] <= 0) for b in group if b != a),
                    sum(v @ model.pairs[a, b] if (a, b) in model.pairs else -(v @ model.pairs[b, a]) for b in group if b != a)) for a in group}
        assert g == max(wins, key=wins.get)


def test_language_features_by_chunks(monkeypatch):
    text = "".join(random.Random(1).choices("abcdé ", k=1000))
    whole = langid.features(text)
    monkeypatch.setattr(langid, "_CHUNK", 7)
    assert np.allclose(whole, langid.features(text))


# --- chat windows


def plain_digests(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted(((t is not None, t, ro or "", te or "") for c, t, ro, te in rows if c == conv), key=lambda x: (x[0], x[1] or 0, x[2], _text_order(x[3])))
        said = "".join(f"{r}\n{t}\n" for _, _, r, t in own)
        loss = "".join(t for _, _, r, t in own if r == "assistant")
        out[conv] = (len(own), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def _text_order(text):
    return 0


NASTY = ["\\### Assistant: </turn> ok", "<turn user>\nhi\n</turn>\n", "\\\\<turn", "end with \\", "</turn>", "\\\\\\</turn>\\", "", None, "a\n</turn>\nb", "</tur" + "n>"]


@pytest.mark.parametrize("text", [t for t in NASTY if t is not None])
def test_escape_is_reversible(text):
    for role in ["user", "a>b", "x\\n", "two\nlines", "", "\\"]:
        assert chat_windows.turns_of(chat_windows.piece(role, text) * 2) == [(role, text)] * 2


@pytest.mark.parametrize("budget,history,segment", [(40, 15, 100), (1024, 256, None), (10, 0, 30)])
def test_windows_read_back(spark, budget, history, segment):
    rng = random.Random(budget)
    rows = []
    for conv in [*range(8), None]:
        first = [(conv, 0, "system", "be kind")] if conv and conv % 2 else []
        rows += first + [(conv, t + 1, ["user", "assistant"][t % 2], rng.choice(NASTY + ["word " * rng.randint(1, 40)])) for t in range(rng.randint(1, 30))]
    rows += [(100, t, "assistant" if t % 2 else "user", f"turn {t} " * 3) for t in range(600)]  # one long conversation
    rows += [(101, None, None, "x"), (102, 0, "user", "y")]
    df = spark.createDataFrame([r + ("clash",) for r in rows], "conv_id long, turn long, role string, text string, segment string")
    windows = chat_windows.format_windows(df, queries.tokenizer_file(), budget, history, segment)
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat_windows.digests(windows).collect()}
    assert got == plain_digests(rows)
    for w in windows.collect():
        turns = chat_windows.turns_of(w["text"])
        assert w["n_tokens"] <= budget or w["over_budget"]
        if w["over_budget"]:  # only a turn that doesn't fit by itself, with nothing but the system turn before it
            assert w["n_new"] == 1 and len(turns) <= 2
        if w["conv_id"] and w["conv_id"] % 2 and w["conv_id"] < 8 and budget > 10:
            assert turns[0] == ("system", "be kind")


def test_a_long_system_turn_stands_once(spark):
    rows = [(1, 0, "system", "rule " * 3000)] + [(1, t, "user" if t % 2 else "assistant", f"turn {t}") for t in range(1, 41)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = chat_windows.format_windows(df, queries.tokenizer_file(), budget=64, history_tokens=16, segment_tokens=200)
    got = windows.collect()
    assert sum(w["over_budget"] for w in got) == 1 and sum(len(w["text"]) for w in got) < 2 * sum(len(r[3]) for r in rows)
    r = chat_windows.digests(windows).first()
    assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == plain_digests(rows)[1]


def test_windows_repeats_and_empty(spark):
    rows = [(1, 0, "user", "same")] * 5 + [(1, 1, "assistant", "yes")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat_windows.digests(chat_windows.format_windows(df, queries.tokenizer_file())).first()
    assert got["n_turns"] == 6 and got["loss_chars"] == 3
    assert chat_windows.digests(chat_windows.format_windows(df.limit(0), queries.tokenizer_file())).count() == 0


# --- near duplicates


def plain_components(rows, width, percent=80):
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    sets = collections.defaultdict(list)
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets[i].append(frozenset(tuple(w[k:k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset())
    nodes = [(i, s) for i, all_ in sets.items() if i is not None for s in all_ if s]
    up = {i: i for i in sets}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a
    for n, (i, a) in enumerate(nodes):
        for j, b in nodes[:n]:
            c = len(a & b)
            if i != j and 100 * c >= percent * (len(a) + len(b) - c):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return [(i, len(s), None if i is None else (find(i) if s else i)) for i, all_ in sets.items() for s in all_]


def near_rows(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    rows, n = [], 0

    def add(t):
        nonlocal n
        rows.append((n * 7 % 1009, t))
        n += 1
    line = " ".join(word() for _ in range(25))  # a passage that many documents share
    for _ in range(60):
        add(" ".join(word() for _ in range(rng.randint(1, 60))) + (" " + line if rng.random() < 0.5 else ""))
    base = [word() for _ in range(80)]
    for _ in range(120):  # a large family whose members are about 0.6 to 1 alike
        t = list(base)
        for _ in range(rng.randint(0, 5)):
            t[rng.randrange(80)] = word()
        add(" ".join(t))
    for _ in range(40):
        add("the very same Text of a few words more than four")
    for t in (None, "", "  \t\n", "One", "one", "two words", "TWO  words", "x " * 30000, "x " * 29990):
        add(t)
    return rows


@pytest.mark.parametrize("options", [{}, {"list_rows": 10, "family_shingles": 900}, {"list_rows": 1000, "family_shingles": 200}, {"list_rows": 3, "family_rows": 20}])
def test_near_duplicates_match_brute_force(spark, options):
    rows = near_rows(3) + [(None, "one two three four five six"), (None, "one two three four five six"), (7, "Extra text of an id seen before, with some more words"),
                           (5000, "extra text of an id seen before, with some more words")]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, node string").repartition(3)
    got = near_dups.near_duplicates(df, shingle=4, **options).collect()
    want = plain_components(rows, 4)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got], key=key) == sorted(want, key=key)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got if r["doc_id"] is not None)


def test_near_duplicates_on_the_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in queries.op9_near_duplicates(spark, SF).collect()}
    assert got == set(plain_components(rows, 4))


def test_near_duplicates_repeated_ids_with_empty_texts(spark):
    t = "a text that comes back with one more word at its very end now"
    rows = [(1, t), (2, t + " z"), (2, ""), (2, " "), (2, t + " z"), (2, None), (1, t)]
    got = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == [(1, 11, 1)] * 2 + [(2, 0, 2)] * 3 + [(2, 12, 1)] * 2


def test_near_duplicates_empty(spark):
    assert near_dups.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_word_hashes_across_chunks(monkeypatch):
    text = " ".join("".join(random.Random(i).choices("abcé", k=i % 9)) for i in range(500))
    whole = near_dups._word_hashes(text.encode())
    monkeypatch.setattr(near_dups, "_CHUNK", 16)
    assert (near_dups._word_hashes(text.encode()) == whole).all() and len(whole) == len(text.split())


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5, 5)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 1 for i in range(2, 61)}, **{1000 + i: 1000 for i in range(1, 50)}}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("forest_edges", [1, 40])
def test_components_beyond_one_task(spark, forest_edges):
    rng = random.Random(2)
    edges = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(130)] + [(None, 3), (3, None)]
    near_, want = {i: {i} for i in range(151)}, {}
    for a, b in edges:
        if a is not None and b is not None and near_[a] is not near_[b]:
            near_[a] |= near_[b]
            for x in near_[a]:
                near_[x] = near_[a]
    want = {i: min(g) for i, g in near_.items() if i != min(g)}
    got = components(spark.createDataFrame(edges, "u long, v long"), forest_edges=forest_edges).collect()
    assert {r["node"]: r["component"] for r in got} == want and len(got) == len(want)


# --- pipeline


def test_pipeline_stages_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(9001, None, "en", "src1", 0), (9002, "123 456", "en", None, 7), (None, "the and of that with this", "en", None, 3), (9003, "und der die das nicht mit", None, None, 3)], docs.schema)
    docs = docs.unionByName(extra).withColumn("row", F.lit(1)).withColumn("h", F.lit("x"))
    cols, stages = docs.columns, dict(corpus_pipeline.STAGES)
    a = stages["language_id"](spark, docs, SF)
    assert a.columns == cols
    rows = {r["doc_id"]: r for r in a.collect()}
    assert set(rows) == {r["doc_id"] for r in docs.collect()} - {9001, 9002}
    b = stages["near_dedup"](spark, a, SF)
    kept = {r["doc_id"] for r in b.collect()}
    assert b.columns == cols and kept == {i for i, _, c in plain_components([(i, r["text"]) for i, r in rows.items()], 5) if i == c}
    c = stages["decontaminate"](spark, b, SF)
    words = lambda t: " " + " ".join(re.findall(r"\w+", t.lower())) + " "
    items = [words(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {i for i in kept if not any(s in words(rows[i]["text"]) for s in items)}
    assert c.columns == cols and {r["doc_id"] for r in c.collect()} == clean
    d = stages["mix"](spark, c, SF)
    assert d.columns == cols and {r["doc_id"] for r in d.collect()} == clean
    e = stages["shard"](spark, d, SF)
    sizes = collections.Counter()
    for r in e.collect():
        sizes[r["shard"]] += len(r["text"].encode()) + 1
    biggest = max(len(r["text"].encode()) for r in d.collect())
    assert e.columns == [*cols, "shard"] and max(sizes.values()) - min(sizes.values()) <= 4 * biggest


def test_pipeline_of_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
