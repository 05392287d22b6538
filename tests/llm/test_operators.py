"""The training-data operators against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from corvane.llm import chat, decontaminate, kernel, minhash, mixing, neighbours, pii, quality, substrings, tokens, toxicity

DATA = "/root/testdata/sf0.001"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")


def prose(rng, n, words=2000):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def words(text):
    return re.findall(r"\w+", text.lower())


# --- kernel -------------------------------------------------------------------------------------


def test_kernel_matches_regex():
    texts = ["Éa b_1, ÑU!", "", None, "x" * 700_000 + " y", "áb"]
    t = kernel.tokenize(texts)
    o = t.offsets
    for i, text in enumerate(texts):
        got = [text[a:b] for a, b in zip(t.start[o[i] : o[i + 1]], t.end[o[i] : o[i + 1]])]
        assert got == (re.findall(r"[\ẃ]+", text) if text else [])
    assert t.hash[0] == kernel.word_hash("éa")


# --- 1 ------------------------------------------------------------------------------------------


def test_grammar_scores_clauses():
    g, lexicon = toxicity.grammar(), toxicity.Lexicon.base()
    texts = ["You are an idiot.", "You are not an idiot.", "She said: you idiot.", "I will kill you.", "They kill time.", "an idiot plan", "nothing here", None, ""]
    score = toxicity.score_texts(texts, lexicon, g)[0]
    assert score[0] == 1.25 and score[1] == 0 and 0 < score[2] < score[0] and score[5] == 0.85
    assert score[3] == 2.5 and score[6] == score[7] == score[8] == 0


def test_threats_are_found():
    g, lexicon = toxicity.grammar(), toxicity.Lexicon.base()
    threats = ["I will kill you.", "I will murder you tonight!", "Kill yourself.", "I'm going to strangle her.", "Ich werde dich umbringen.", "we will lynch all of them"]
    assert (toxicity.score_texts(threats, lexicon, g)[0] >= toxicity.THRESHOLD).all()
    mild = ["I will never kill you.", "He said: I will kill you.", "Don't kill yourself over it.", "kill the process. You can restart it.", "to kill time", "stab, then you"]
    assert (toxicity.score_texts(mild, lexicon, g)[0] < toxicity.THRESHOLD).all()


def plain_score(text, lexicon):
    """The rules of the docstring, each by looking back from its word; no transducers."""
    T = toxicity
    known = dict(zip(lexicon.words.tolist(), lexicon.classes.tolist()))
    c = [known.get(kernel.word_hash(w), T.OTHER) for w in re.findall(r"\w+|[^\w\s]+", text.lower())]

    def back(i, reach, wanted, stops):
        for j in range(i - 1, max(-1, i - reach - 1), -1):
            if wanted(j):
                return True
            if c[j] in stops:
                return False
        return False

    ends, strong = (T.CLAUSE, T.SENTENCE), (T.INSULT, T.THREAT)
    denied = [x in strong and back(i, 3, lambda j: c[j] == T.NEGATION, ends) for i, x in enumerate(c)]
    quoted = [x in strong and not denied[i] and back(i, 12, lambda j: c[j] == T.REPORT, (T.SENTENCE,)) for i, x in enumerate(c)]
    aimed = [x in strong and not denied[i] and not quoted[i] and back(i, 5, lambda j: c[j] == T.TARGET, ends) for i, x in enumerate(c)]
    bare = [x in strong and not (denied[i] or quoted[i] or aimed[i]) for i, x in enumerate(c)]
    total = 0.0
    for i, x in enumerate(c):
        if x in strong and not denied[i]:
            total += 0.34 if quoted[i] else (1.25 if x == T.INSULT else 2.5) if aimed[i] else 0.85 if x == T.INSULT else 0.4
        elif x == T.TARGET:
            if back(i, 5, lambda j: bare[j] and c[j] == T.THREAT, (*ends, T.TARGET)):
                total += 2.1
            elif back(i, 5, lambda j: bare[j] and c[j] == T.INSULT, ends):
                total += 0.25
    return total


def test_composition_matches_plain_rules():
    rng = random.Random(15)
    vocabulary = ["you", "idiot", "not", "said", "kill", "they", "word", ".", ",", "trash", "stab", "a", "b", "c", "d", "e"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(80))) for _ in range(300)]
    g, lexicon = toxicity.grammar(), toxicity.Lexicon.base()
    assert np.allclose(toxicity.score_texts(texts, lexicon, g)[0], [plain_score(t, lexicon) for t in texts])


def slow_score(text, lexicon, machine):
    known = dict(zip(lexicon.words.tolist(), lexicon.classes.tolist()))
    state, total = 0, 0.0
    for word in re.findall(r"\w+|[^\w\s]+", text.lower()):
        c = known.get(kernel.word_hash(word), 0)
        total += toxicity.SCORE[machine.out[state, c]] * machine.weight[state, c]
        state = machine.next[state, c]
    return total


def test_grammar_matches_one_token_at_a_time():
    rng = random.Random(5)
    vocabulary = ["you", "idiot", "not", "said", "kill", "they", "word", "other", ".", ",", "trash", "plain", "a", "b", "c"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(60))) for _ in range(60)]
    g, lexicon = toxicity.grammar(), toxicity.Lexicon.base()
    got = toxicity.score_texts(texts, lexicon, g)[0]
    assert np.allclose(got, [slow_score(t, lexicon, g) for t in texts])


def test_toxicity_passage_in_a_long_text(spark):
    clean = "the river runs past the old mill and the meadow . " * 2000
    apart = "stupid . " + clean  # one bare insult isn't enough, nor are two far from each other
    rows = [(1, clean, "a"), (2, clean + "you i will strangle . " + clean, "a"), (3, clean + "you idiot . " + clean, "a"), (4, apart + apart, "a"), (5, clean + "she said you idiot . " + clean, "a"), (6, clean + "you idiot", "a"), (7, "you idiot . " + clean, "a")]
    labels = spark.createDataFrame([], "doc_id long, toxic double")
    got = {r["doc_id"] for r in toxicity.toxic_documents(docs_of(spark, rows), labels).collect()}
    assert got == {2, 3, 6, 7}


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    train, held = labels.filter("doc_id % 2 = 0"), {r["doc_id"]: r["toxic"] for r in labels.filter("doc_id % 2 = 1").collect()}
    flagged = {r["doc_id"] for r in toxicity.toxic_documents(spark.read.parquet(f"{d}/documents.parquet"), train).collect()}
    bad = [i for i, t in held.items() if t]
    good = [i for i, t in held.items() if not t]
    assert np.mean([i in flagged for i in bad]) > 0.8 and np.mean([i in flagged for i in good]) < 0.02


# --- 2 ------------------------------------------------------------------------------------------


def test_encoder_equals_tiktoken():
    e = tokens.Encoder(tokens.load_ranks())
    rng = random.Random(1)
    alphabet = "ab é'sStTdrevl \n\t　 09½#$.λ字🎉\r\x1c"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(50))) for _ in range(2000)] + ["don't we'll 'tis ''s I'VE", "   x  ", "\n\n a"]
    for text, ids in zip(texts, e.encode(texts)):
        assert ids.tolist() == e.plain.encode_ordinary(text)


def test_perfect_hash_is_minimal():
    for n in (0, 1, 2, 5, 300, 3000):
        h = kernel.mix(np.arange(n, dtype=np.uint64) + np.uint64(99))
        slots, pilots = tokens.perfect_hash(h)
        assert sorted(slots.tolist()) == list(range(n))
        assert all(tokens.find_slot(int(x), pilots, n) == s for x, s in zip(h, slots))


def test_token_index_round_trip(spark, tmp_path):
    rows = [(i, f"text {i} é" * (i % 5), "a") for i in range(300)] + [(7, "another seven", "a"), (None, "no id", "a"), (None, "none here", "a"), (400, None, "a")]
    index = tokens.token_index(docs_of(spark, rows), docs_per_shard=50)
    tokens.pack_shards(index).repartitionByRange(4, "shard").sortWithinPartitions("shard").write.parquet(f"{tmp_path}/packed")
    packed = spark.read.parquet(f"{tmp_path}/packed")
    plain = tokens.Encoder(tokens.load_ranks()).plain
    # from the key alone: its shard, its slot, its ids
    assert plain.decode(tokens.find(packed, 42).tolist()) == rows[42][1]
    assert tokens.find(packed, 10**9) is None and tokens.find(packed, 42, 1) is None and tokens.find(packed.limit(0), 42) is None
    keys = [(i, 0) for i in range(300)] + [(7, 1), (400, 0), (10**9, 0), (42, 5)]
    found = {(r["doc_id"], r["copy"]): r for r in tokens.lookup(packed, spark.createDataFrame([*keys, (None, 0)], "doc_id long, copy int")).collect()}
    assert set(found) == set(keys) and all(found[k]["ids"] is None for k in keys[-2:])
    decoded = sorted((k[0], plain.decode(np.frombuffer(bytes(found[k]["ids"]), "<u2").tolist())) for k in keys[:-2])
    assert decoded == sorted((i, t or "") for i, t, _ in rows if i is not None)
    readers = {r["shard"]: tokens.read_packed(r) for r in packed.collect()}
    nulls = index.filter("doc_id IS NULL").collect()
    assert sorted(plain.decode(readers[r["shard"]].get(None, r["copy"]).tolist()) for r in nulls) == ["no id", "none here"]
    assert {r["n_shards"] for r in index.collect()} == {7}


# --- 3 ------------------------------------------------------------------------------------------


def recall(x, y, got, k=10, apart=False):
    """Share of the k exact neighbours among y of each row of x that are in got."""
    u, v = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (x, y))
    sims = u @ v.T
    if not apart:
        np.fill_diagonal(sims, -9)
    want = np.argsort(-sims, 1)[:, :k]
    return np.mean([len({n for _, n in got[i]} & set(want[i].tolist())) / k for i in range(len(x))])


def neighbours_by_row(rows):
    got: dict[int, list] = {}
    for r in rows:
        got.setdefault(r["vec_id"], []).append((r["rank"], r["neighbour_id"]))
    return got


@pytest.mark.parametrize("n", [300, 2500])
def test_neighbour_recall(spark, n):
    x = np.random.default_rng(0).normal(size=(n, 24)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = neighbours_by_row(neighbours.nearest_neighbours(df, 10).collect())
    assert recall(x, x, got) >= 0.95 and all(sorted(r for r, _ in v) == list(range(1, 11)) for v in got.values())


def test_neighbours_of_other_vectors(spark):
    rng = np.random.default_rng(1)
    x, q = rng.normal(size=(1500, 24)).astype(np.float32), rng.normal(size=(200, 24)).astype(np.float32)
    vectors = lambda m: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(None, [1.0] * 24), (10**6, [1.0])], "vec_id long, embedding array<float>")
    got = neighbours_by_row(neighbours.search_neighbours(vectors(q), vectors(x), 10).collect())
    assert set(got) == set(range(200)) and recall(q, x, got, apart=True) >= 0.9
    assert neighbours.search_neighbours(vectors(q), vectors(x).limit(0)).collect() == []


@pytest.mark.parametrize("few", [False, True])
def test_scan_is_exact(spark, monkeypatch, few):
    if few:  # several passes, a sample first
        monkeypatch.setattr(neighbours, "QUERIES", 20)
        monkeypatch.setattr(neighbours, "SHELF", 256)
    x = np.random.default_rng(3).normal(size=(2500, 24)).astype(np.float32)
    x[100:140] = x[50]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(None, [1.0] * 24), (5000, [1.0]), (5050, None)], "vec_id long, embedding array<float>")
    got = neighbours_by_row(neighbours.scanned_neighbours(df, 10).collect())
    u = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float64)
    want = {i: [(r + 1, j) for r, j in enumerate(sorted((j for j in range(len(x)) if j != i), key=lambda j: (-round(float(u[i] @ u[j]), 6), j))[:10])] for i in range(0, 2500, 50)}
    assert {i: sorted(v) for i, v in got.items()} == want
    assert neighbours.scanned_neighbours(df.limit(0)).collect() == []


def test_op3_asks_for_every_fiftieth_row(spark):
    rows = neighbours.op3_neighbours(spark, "/root/testdata/sf0.001").collect()
    assert sorted((r["vec_id"], r["rank"]) for r in rows) == [(i, r) for i in range(0, 500, 50) for r in range(1, 11)]


# --- 4 ------------------------------------------------------------------------------------------


def test_private_spans_of_planted_texts(spark):
    rng = random.Random(2)
    rows, truth = [], set()
    makers = {
        "email": lambda: f"{rng.choice('abc')}n.{rng.randrange(99)}@mail{rng.randrange(9)}.example.com",
        "ip": lambda: ".".join(str(rng.randrange(1, 255)) for _ in range(4)),
        "phone": lambda: f"+1 ({rng.randrange(100, 999)}) 555-{rng.randrange(1000, 9999)}",
        "card": lambda: "".join(str(rng.randrange(10)) for _ in range(16)),
    }
    for i in range(200):
        kind = list(makers)[i % 5] if i % 5 < 4 else None
        value = makers[kind]() if kind else "Version 2.0"
        text = f"{prose(rng, 8).replace('w', 'word ')[:40]}xx {value} und so".replace("  ", " ")
        text = re.sub(r"\d+(?=.*xx)", "", text)
        rows.append((i, text, "a"))
        if kind:
            at = text.index(value)
            truth.add((i, at, at + len(value), kind))
    got = {(r["doc_id"], r["start"], r["end"], r["kind"]) for r in pii.private_spans(docs_of(spark, rows)).collect()}
    assert got == truth


def test_private_spans_without_digits_and_ip6(spark):
    rng = random.Random(5)
    rows, truth = [], set()
    for i in range(120):
        word = "".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randrange(8, 20)))
        value, kind, form = [
            (word, "secret", 'password = "{}" and more'),
            (word[:4] + str(rng.randrange(100, 999)), "secret", "pwd={} and more"),
            (f"2001:db8:{rng.randrange(1, 9999):x}::{rng.randrange(1, 9999):x}", "ip", "the host {} is down"),
            ("2.0", None, "Version {} of it"),
            ("string", None, 'token: "{}" and more'),
            ("".join(rng.choice("0123456789abcdef") for _ in range(32)), "secret", 'api_key = "{}" und so'),
        ][i % 6]
        text = form.format(value)
        rows.append((i, text, "a"))
        if kind:
            truth.add((i, text.index(value), text.index(value) + len(value), kind))
    got = {(r["doc_id"], r["start"], r["end"], r["kind"]) for r in pii.private_spans(docs_of(spark, rows)).collect()}
    assert got == truth
    text = "auth: me@mail.example.com, token: +1 (555) 555-1234; at 12:30:45.5"
    assert [text[a:b] for a, b in pii.candidates(text)] == ["me@mail.example.com", "+1 (555) 555-1234", "12:30:45.5"]


def test_em_finds_the_bad_labeler():
    rng = np.random.default_rng(1)
    true = rng.choice(3, 600, p=[0.6, 0.25, 0.15])
    votes = np.stack([np.where(rng.random(600) < p, true, rng.choice(3, 600)) for p in (0.9, 0.85, 0.1)], 1)
    patterns, which, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    post, confusion, _ = pii.expectation_maximisation(patterns, counts)
    hits = [np.mean([confusion[j, k, k] for k in range(3)]) for j in range(3)]
    assert min(hits[:2]) > hits[2] and np.mean(post[which.ravel()].argmax(1) == true) > 0.8


def plain_em(patterns, counts, rounds):
    """Dawid-Skene by loops over single votes, with the same start and smoothing."""
    k, abstain = pii.K, pii.ABSTAIN
    post = []
    for row in patterns:
        p = [0.1 / k + sum(v == t for v in row) for t in range(k)]
        post.append([x / sum(p) for x in p])
    for _ in range(rounds):
        shares = [1.0 + sum(n * p[t] for n, p in zip(counts, post)) for t in range(k)]
        shares = [x / sum(shares) for x in shares]
        rates = []
        for j in range(len(patterns[0])):
            table = [[0.1 + (v == t) + (v == k) for v in range(k + 1)] for t in range(k)]
            for row, n, p in zip(patterns, counts, post):
                for t in range(k):
                    table[t][k if row[j] == abstain else row[j]] += n * p[t]
            rates.append([[x / sum(line) for x in line] for line in table])
        post = []
        for row in patterns:
            p = list(shares)
            for j, v in enumerate(row):
                p = [x * rates[j][t][k if v == abstain else v] for t, x in enumerate(p)]
            post.append([x / sum(p) for x in p])
    return post


def test_em_matches_plain_loops():
    rng = np.random.default_rng(3)
    patterns = np.unique(rng.integers(-1, 4, (60, 5)), axis=0)
    counts = rng.integers(1, 50, len(patterns))
    for rounds in (1, 2, 7):
        post, _, _ = pii.expectation_maximisation(patterns, counts, rounds)
        assert np.allclose(post, plain_em(patterns.tolist(), counts.tolist(), rounds), atol=1e-6)


def test_private_spans_of_long_texts():
    import time

    for unit in ("a.", "a-", "token", "token=", "@", 'token="', "1.", "a"):
        text = unit * (1_000_000 // len(unit)) + "1 me@mail.example.com"
        began = time.perf_counter()
        found = pii.candidates(text)
        assert time.perf_counter() - began < 15 and text[slice(*found[-1])].endswith("me@mail.example.com")
    key = "k9" * 50_000
    (a, b), = pii.candidates(f'the password is "{key}" here')
    assert (b - a) == len(key) and pii.features(key, 'the password is "')
    assert pii.candidates("a secret: password = hunter22") == [(21, 29)]


# --- 5 ------------------------------------------------------------------------------------------


def slow_windows(turns, budget, history):
    sys_turn = next((t for t in turns if t[0] == "system"), None)
    rest = [t for t in turns if t is not sys_turn]
    fixed = sys_turn[1] if sys_turn else 0
    out, i = [], 0
    if not rest:
        return [[(sys_turn, False)]] if sys_turn else []
    while i < len(rest):
        h = max((k for k in range(history + 1) if k <= i and i > 0 and fixed + sum(t[1] for t in rest[i - k : i]) + rest[i][1] <= budget), default=0)
        used, j = fixed + sum(t[1] for t in rest[i - h : i]) + rest[i][1], i + 1
        while j < len(rest) and used + rest[j][1] <= budget:
            used += rest[j][1]
            j += 1
        window = ([(sys_turn, bool(out))] if sys_turn else []) + [(t, False) for t in rest[i - h : i]] + [(t, True) for t in rest[i:j]]
        out.append(window)
        i = j
    return out


def test_chat_windows_match_loop(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for c in range(30):
        turns = []
        for t in range(rng.randrange(1, 12)):
            role = "system" if t == 0 and c % 3 == 0 else rng.choice(["user", "assistant"])
            text = " ".join("x" for _ in range(rng.randrange(0, 30)))
            rows.append((c, t, role, text))
            turns.append((role, len(text.split()) + 4, t))
        want[c] = slow_windows(turns, 40, 2)
    got: dict = {}
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for r in sorted(chat.chat_windows(df, budget=40).collect(), key=lambda r: (r["conv_id"], r["window_no"], r["position"])):
        got.setdefault(r["conv_id"], {}).setdefault(r["window_no"], []).append((r["turn"], r["in_loss"]))
    for c, windows in want.items():
        plain = [[(t[2], fresh and t[0] == "assistant") for t, fresh in w] for w in windows]
        assert [got[c][k] for k in sorted(got[c])] == plain


# --- 6 ------------------------------------------------------------------------------------------


def covered(texts: dict[int, str], span: int) -> set[tuple[int, int, int]]:
    seen: dict[tuple, list] = {}
    for i, t in texts.items():
        w = words(t)
        for p in range(len(w) - span + 1):
            seen.setdefault(tuple(w[p : p + span]), []).append((i, p))
    marks: dict[int, set] = {}
    for places in seen.values():
        if len(places) > 1:
            for i, p in places:
                marks.setdefault(i, set()).update(range(p, p + span))
    out = set()
    for i, m in marks.items():
        run = sorted(m)
        start = run[0]
        for a, b in zip(run, [*run[1:], None]):
            if b != a + 1:
                out.add((i, start, a + 1))
                start = b
    return out


def test_matching_statistics():
    rng = np.random.default_rng(0)
    for _ in range(15):
        regions = [rng.integers(1, 4, rng.integers(1, 25)) for _ in range(rng.integers(1, 10))]
        text = np.concatenate([np.append(r, 0) for r in regions])
        lengths = np.array([len(r) + 1 for r in regions])
        start = np.cumsum(lengths) - lengths
        got = substrings.FMIndex(text, lengths).matching_statistics(text, start, start + lengths - 1)
        count: dict = {}
        for r in regions:
            for i in range(len(r)):
                for j in range(i + 1, len(r) + 1):
                    count[tuple(r[i:j])] = count.get(tuple(r[i:j]), 0) + 1
        for r, s in zip(regions, start):
            for i in range(len(r)):
                assert got[s + i] == max((j - i for j in range(i + 1, len(r) + 1) if count[tuple(r[i:j])] > 1), default=0)


def test_repeated_spans_match_brute_force(spark):
    rng = random.Random(6)
    passages = [prose(rng, n) for n in (50, 51, 49, 80, 300)]
    texts = {i: prose(rng, rng.randrange(5, 120)) for i in range(60)}
    for i in range(0, 40):
        texts[i] = " ".join([prose(rng, rng.randrange(30)), passages[i % 5], prose(rng, rng.randrange(30)), passages[(i * 7) % 5]][: 2 + 2 * (i % 3 == 0)])
    texts[58] = texts[57]  # a copy
    texts[59] = "echo " * 130  # repeats itself
    got = {(r["doc_id"], r["start_word"], r["end_word"]) for r in substrings.repeated_spans(docs_of(spark, [(i, t, "a") for i, t in texts.items()])).collect()}
    assert got == covered(texts, 50)


def test_repeated_spans_of_hot_prints(spark, monkeypatch):
    monkeypatch.setattr(substrings, "HOT", 3)
    test_repeated_spans_match_brute_force(spark)


@pytest.mark.parametrize("span", [13, 257, 300])
def test_repeated_spans_of_any_length(spark, span):
    rng = random.Random(span)
    passages = [prose(rng, n) for n in (span - 1, span, span + 1, 2 * span + 30)]
    texts = {i: " ".join([prose(rng, rng.randrange(40)), passages[i % 4], prose(rng, rng.randrange(40))]) for i in range(12)}
    got = {(r["doc_id"], r["start_word"], r["end_word"]) for r in substrings.repeated_spans(docs_of(spark, [(i, t, "a") for i, t in texts.items()]), span=span).collect()}
    assert got == covered(texts, span) and len(got) == 9


# --- 7 ------------------------------------------------------------------------------------------


def jaccard(a, b):
    x, y = ({tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} for w in (words(a), words(b)))
    return len(x & y) / len(x | y)


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(8)
    texts = {i: prose(rng, rng.randrange(40, 300)) for i in range(40)}
    for i in range(40, 80):
        w = texts[rng.randrange(40)].split()
        for _ in range(len(w) // 40):
            w[rng.randrange(len(w))] = "changed"
        texts[i] = " ".join(w)
    texts[80] = texts[3]
    texts[81] = texts[3].upper() + "!"
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in texts:
        for j in texts:
            if i < j and jaccard(texts[i], texts[j]) > 0.7:
                root[max(find(i), find(j))] = min(find(i), find(j))
    want = {(i, find(i)) for i in texts if find(i) != i}
    got = {(r["doc_id"], r["kept_id"]) for r in minhash.near_duplicates(docs_of(spark, [(i, t, "a") for i, t in texts.items()])).collect()}
    assert got == want


def test_near_duplicates_of_a_matched_member(spark):
    """The original stands in the middle of the ids: every bucket of it has an earlier copy as its hub,
    which the later copies don't match."""
    rng = random.Random(31)
    base = prose(rng, 500)

    def near(text, other):
        s, _ = minhash.signatures([text, other])
        return (s[0] == s[1]).mean() >= minhash.THRESHOLD

    def copies(n, far=()):
        while n:
            text = " ".join(f"x{rng.random()}" if rng.random() < 0.085 else w for w in base.split())
            if near(text, base) and not any(near(text, x) for x in far):
                n -= 1
                yield text

    last = list(copies(2))
    texts = dict(enumerate(copies(40, last))) | {50: base} | dict(enumerate(last, 60))
    ids = list(texts)
    sigs, _ = minhash.signatures([texts[i] for i in ids])
    bands = sigs.reshape(len(ids), -1, minhash.ROWS)
    root = {i: i for i in ids}
    for _ in ids:
        for x, i in enumerate(ids):
            for y, j in enumerate(ids):
                if (sigs[x] == sigs[y]).mean() >= minhash.THRESHOLD and (bands[x] == bands[y]).all(1).any():
                    root[i] = root[j] = min(root[i], root[j])
    assert root[60] == 0
    got = {(r["doc_id"], r["kept_id"]) for r in minhash.near_duplicates(docs_of(spark, [(i, t, "a") for i, t in texts.items()])).collect()}
    assert got == {(i, r) for i, r in root.items() if i != r}


def test_near_duplicates_split_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(minhash, "PIECE", 2)
    test_near_duplicates_of_a_matched_member(spark)


@pytest.mark.parametrize("rows", [1, 3, 4, 8])
def test_near_duplicates_near_the_threshold(spark, rows):
    """Estimates of 0.45 to 0.65 and every number of rows: all pairs that share a band, and no others."""
    rng = random.Random(40 + rows)
    texts = {}
    for g in range(12):
        base = prose(rng, 200).split()
        for k in range(5):
            texts[g * 10 + k] = " ".join(f"y{rng.random()}" if k and rng.random() < 0.02 + 0.025 * k else w for w in base)
    ids = list(texts)
    sigs, _ = minhash.signatures([texts[i] for i in ids])
    n = minhash.BINS // rows
    bands = sigs[:, : n * rows].reshape(len(ids), n, rows)
    root, near = {i: i for i in ids}, 0
    for x in range(len(ids)):
        for y in range(x):
            sim = (sigs[x] == sigs[y]).mean()
            near += 0.5 <= sim <= 0.6
            if sim >= minhash.THRESHOLD and (bands[x] == bands[y]).all(1).any():
                old, new = sorted((root[ids[x]], root[ids[y]]), reverse=True)
                root = {i: new if r == old else r for i, r in root.items()}
    assert near > 5
    got = {(r["doc_id"], r["kept_id"]) for r in minhash.near_duplicates(docs_of(spark, [(i, t, "a") for i, t in texts.items()]), rows=rows).collect()}
    assert got == {(i, r) for i, r in root.items() if i != r}


def test_signatures_estimate_jaccard():
    rng = random.Random(9)
    base = prose(rng, 400).split()
    for share in (0.02, 0.1):
        other = [("z" if rng.random() < share else w) for w in base]
        a, b = " ".join(base), " ".join(other)
        s, _ = minhash.signatures([a, b])
        assert abs((s[0] == s[1]).mean() - jaccard(a, b)) < 0.15


# --- 8 ------------------------------------------------------------------------------------------


def test_contaminated_spans_match_brute_force(spark):
    rng = random.Random(10)
    items = {i: prose(rng, rng.randrange(14, 60), 500) for i in range(12)}
    docs = {i: prose(rng, rng.randrange(5, 150), 500) for i in range(40)}
    for i in range(0, 30):
        w = words(items[i % 12])
        cut = w[: rng.randrange(10, len(w) + 1)]
        docs[i] = f"{prose(rng, rng.randrange(20), 500)}. {' '.join(cut).upper()}, {docs[i]}"
    want = set()
    for d, t in docs.items():
        x = words(t)
        for b, u in items.items():
            y = words(u)
            for p in range(len(x)):
                for q in range(len(y)):
                    if x[p] == y[q] and (p == 0 or q == 0 or x[p - 1] != y[q - 1]):
                        n = 0
                        while p + n < len(x) and q + n < len(y) and x[p + n] == y[q + n]:
                            n += 1
                        if n >= 13:
                            want.add((d, b, p, p + n, q))
    bench = spark.createDataFrame([(i, t) for i, t in items.items()], "item_id long, text string")
    df = docs_of(spark, [(i, t, "a") for i, t in docs.items()])
    for limit in (decontaminate.BROADCAST_PRINTS, 0):  # both ways to join
        decontaminate.BROADCAST_PRINTS, old = limit, decontaminate.BROADCAST_PRINTS
        try:
            got = {tuple(r) for r in decontaminate.contaminated_spans(df, bench).collect()}
        finally:
            decontaminate.BROADCAST_PRINTS = old
        assert got == want and len(want) > 15


# --- 9 ------------------------------------------------------------------------------------------


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    held = {r["doc_id"]: r["quality"] for r in labels.filter("doc_id % 2 = 1").collect()}
    got = {r["doc_id"]: r for r in quality.score_quality(spark.read.parquet(f"{d}/documents.parquet"), labels.filter("doc_id % 2 = 0")).collect()}
    assert len(got) == spark.read.parquet(f"{d}/documents.parquet").count()
    right = [got[i]["is_kept"] == bool(q) for i, q in held.items()]
    kept = [got[i]["is_kept"] for i, q in held.items() if q]
    p = np.clip([got[i]["p_quality"] for i in held], 1e-4, 1 - 1e-4)
    y = np.array(list(held.values()))
    assert np.mean(right) > 0.97 and np.mean(kept) > 0.99
    assert -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean() < 0.15


@pytest.mark.parametrize("share", [0.0, 0.2, 1.1])
def test_word_vectors_match_plain_counts(spark, monkeypatch, share):
    """Words with vectors of their own, and words that share them by hash."""
    monkeypatch.setattr(quality, "MIN_SHARE", share)
    texts = ["a b c d", "b a. x", "", None, "a b a b a b"]
    known, got = quality.word_vectors(docs_of(spark, [(i, t, "s") for i, t in enumerate(texts)]))
    found = [re.findall(r"\w+|[^\w\s]+", t or "") for t in texts]
    count: dict = {}
    for w in (w for t in found for w in t):
        count[w] = count.get(w, 0) + 1
    own = {w for w, n in count.items() if n >= share * sum(count.values())}
    assert len(known.words) == len(own) == {0.0: 6, 0.2: 2, 1.1: 0}[share]
    hashes = {w: kernel.tokenize([w], punctuation=True, lowered=False).hash[0] for w in count}
    name = {w: hashes[w] if w in own else hashes[w] >> np.uint64(50) for w in count}
    total: dict = {}
    for t in found:
        for i, w in enumerate(t):
            for j in range(max(0, i - 2), min(len(t), i + 3)):
                if j != i:
                    places, signs = quality.index_vectors(np.array([name[t[j]]], np.uint64))
                    np.add.at(total.setdefault(name[w], np.zeros(quality.DIMENSIONS)), places[0], signs[0])
    for w in count:
        v = total[name[w]]
        assert np.allclose(got[known.places(np.array([hashes[w]], np.uint64))[0]], v / max(np.linalg.norm(v), 1e-12), atol=1e-6)


def test_vocabulary_places():
    rng = np.random.default_rng(2)
    words = np.sort(np.unique(np.concatenate([rng.integers(0, 2**63, 5000, np.uint64), np.arange(50, dtype=np.uint64) + (np.uint64(7) << np.uint64(44))])))
    known = quality.Vocabulary(words)
    assert (known.places(words) == quality.BUCKETS + np.arange(len(words))).all()
    other = np.setdiff1d(np.concatenate([rng.integers(0, 2**63, 5000, np.uint64), np.arange(50, 90, dtype=np.uint64) + (np.uint64(7) << np.uint64(44))]), words)
    assert (known.places(other) == (other >> np.uint64(50)).astype(int)).all()


def test_network_and_temperature_match_plain_numbers():
    """The probability by single multiplications, and the temperature by a finer search."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 6))
    y = (x[:, 0] * x[:, 1] + 0.5 * rng.normal(size=600) > 0).astype(float)
    net = quality.Network.fit(x, y, epochs=20)
    for row in x[:20]:
        z = [(a - m) / s for a, m, s in zip(row, net.mean, net.scale)]
        h = [max(0.0, sum(z[i] * net.w1[i, j] for i in range(6)) + net.b1[j]) for j in range(len(net.b1))]
        logit = sum(a * b for a, b in zip(h, net.w2)) + net.b2
        assert abs(net.probability(row[None, :])[0] - 1 / (1 + np.exp(-logit / net.temperature))) < 1e-9
    held = np.random.default_rng(0).permutation(600)[:120]
    loss = lambda t: -np.mean(np.log(np.where(y[held] == 1, 1 / (1 + np.exp(-net.logits(x[held]) / t)), 1 / (1 + np.exp(net.logits(x[held]) / t)))))
    best = min(np.geomspace(0.25, 8, 400), key=loss)
    assert loss(net.temperature) <= loss(best) + 1e-3


# --- 10 -----------------------------------------------------------------------------------------


def test_mixing_meets_budgets(spark):
    rng = random.Random(12)
    rows = [(i, prose(rng, rng.randrange(1, 40)), f"s{i % 3 if i % 7 else 0}") for i in range(300)]
    df = docs_of(spark, rows)
    targets = spark.createDataFrame([("s0", 1.0), ("s1", 3.0), ("s2", 0.0)], "source string, weight double")
    got = {r["doc_id"]: r for r in mixing.mix_sources(df, targets).collect()}
    n = {i: len(t.split()) for i, t, _ in rows}
    total = sum(n.values())
    for s, share in (("s0", 0.25), ("s1", 0.75), ("s2", 0.0)):
        own = [i for i, _, x in rows if x == s]
        budget = int(total * share)
        taken = sum(n[i] * got[i]["copies"] for i in own if i in got)
        assert taken <= budget
        copies = {got[i]["copies"] if i in got else 0 for i in own}
        assert len(copies) <= 2 and max(copies) - min(copies) <= 1
        if share:
            assert budget - taken < 40 * max(1, len(own)) and budget - taken <= max(n.values())
    whole = mixing.mix_sources(df, targets, rows=True)
    assert whole.columns == df.columns and whole.count() == sum(r["copies"] for r in got.values())
