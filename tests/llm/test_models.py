from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from corpusflow.llm import near, quality, secrets, toxicity
from corpusflow.llm.automata import Automaton
from corpusflow.llm.trees import BoostedTrees, Isotonic

rng = random.Random(12)
word = lambda: "".join(rng.choice("bcdfgh") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))
sentence = lambda n=12: " ".join(word() for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def labelled_docs(spark):
    docs, labels = [], []
    for i in range(600):
        words = " ".join(sentence() for _ in range(rng.randint(3, 12))).split()
        toxic, junk = i % 5 == 0, i % 3 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["you idiot", "zumbrat", "zumbratter", "STUPID!!", "sc*m"]))
        if junk:
            words = [w + rng.choice(["###", "%%%", "***"]) for w in words]
        docs.append((i, " ".join(words)))
        labels.append((i, int(not junk), int(toxic)))
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def held_out(model_of, labelled_docs, column):
    docs, labels = labelled_docs
    model = model_of(docs, labels.where("doc_id % 2 = 0"))
    rows = docs.where("doc_id % 2 = 1").join(labels, "doc_id").collect()
    p = model.probability(pa.array([r["text"] for r in rows]))
    y = np.array([r[column] for r in rows])
    return model, p, y


def test_toxicity_on_held_out_documents(labelled_docs):
    model, p, y = held_out(toxicity.train, labelled_docs, "toxic")
    assert ((p >= 0.5) == y).mean() > 0.95
    assert abs(p.mean() - y.mean()) < 0.05, "probabilities are calibrated"
    assert {"zumbrat", "zumbratter"} <= model.lexicon.words | {w for w in ("zumbrat", "zumbratter") if w[:6] in model.lexicon.stems}


def test_quality_on_held_out_documents(labelled_docs):
    model, p, y = held_out(quality.train, labelled_docs, "quality")
    assert ((p >= 0.5) == y).mean() > 0.97
    loss = lambda q: -np.mean(np.log(np.where(y == 1, q, 1 - q)))
    assert loss(np.clip(p, 1e-9, 1 - 1e-9)) < 0.2


def test_without_labels(labelled_docs):
    docs, labels = labelled_docs
    few = labels.where("doc_id < 5")
    seeds = toxicity.train(docs, few)
    assert seeds.trees is None and seeds.probability(pa.array(["you idiot", "fine words here", None])).round().tolist() == [1, 0, 0]
    assert quality.train(docs, few).probability(pa.array(["x", None])).tolist() == [0.5, 0.5]


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, None, None), (None, 1, 1), (99, 1, 1), (6, 1, 0), (6, 1, 0)], "doc_id bigint, quality int, toxic int")
    scored = toxicity.score(odd, toxicity.train(odd, labels)).collect()
    assert len(scored) == 13 and not any(r["toxic"] for r in scored)
    kept = toxicity.reject_toxic(odd, toxicity.train(odd, labels))
    assert kept.columns == odd.columns and kept.count() == 13
    rated = quality.score(odd, quality.train(odd, labels)).collect()
    assert len(rated) == 13 and all(r["keep"] for r in rated)
    for module in (toxicity, quality):
        assert module.score(empty, module.train(empty, labels)).count() == 0


def test_labels_without_documents_take_no_place(labelled_docs, spark):
    docs, labels = labelled_docs
    orphans = labels.selectExpr("doc_id + 100000 as doc_id", "quality", "toxic")
    for column in ("toxic", "quality"):
        assert toxicity.labelled(docs, labels.union(orphans), 200, column).count() == 200


def test_words_of_other_languages_are_no_seeds():
    seeds = toxicity.Model(toxicity.Lexicon())
    clean = ["Die Katze und die Maus gaben dem Hund einen guten Rat, als es hell war.", "Le rat et le chien sont dans la maison.", "El con que sale la luz."]
    assert seeds.probability(pa.array(clean)).max() == 0
    toxic = ["Du bist ein Trottel und ein Versager.", "Tu es un crétin.", "Eres un idiota."]
    assert (seeds.probability(pa.array(toxic)) >= 0.5).all()


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_toxicity_features_equal_brute_force(seed):
    import re

    r = random.Random(seed)
    lexicon = toxicity.Lexicon({"zumbrat"}, {"glorp"})
    pool = ["idiot", "IDIOT!", "id1ot", "iiidiot", "zumbrat", "zumbrat,", "glorpish", "hate", "shit", "you", "You,", "dein", "plain", "Word.", "SHOUT", "a1b", "w@rd", "!!!", "...", "x-y", "é", "don't", "***"]
    texts = [" ".join(r.choices(pool, k=r.randint(0, 25))) for _ in range(40)] + ["", None, "  "]
    every = set().union(*toxicity.SEED.values()) | lexicon.words
    want = []
    for text in texts:
        words = (text or "").split()
        rows, toxic, second = [], [], []
        for w in words:
            core = re.sub(r"^\W+|\W+$", "", w)
            low = core.lower()
            short = re.sub(r"(.)\1{2,}", r"\1", low)
            marks = sum(not (c.isalnum() or c == "_") for c in w)
            odd = not core.isalpha() and (any(not (c.isalnum() or c == "_") for c in core) or (any(map(str.isdigit, core)) and any(map(str.isalpha, core))))
            plain = re.sub(r"\W", "", low.translate(str.maketrans("013457@$!", "oieastasi")))
            disguised = odd and plain != low and plain in every
            stretched = short != low and short in every
            own = [low in g for g in toxicity.SEED.values()] + [low in lexicon.words, any(low[:n] in lexicon.stems for n in toxicity.STEMS)]
            toxic.append(any(own) or disguised or stretched)
            second.append(low in toxicity.SECOND)
            rows.append([*own, low in toxicity.SECOND, len(core) > 1 and core.isupper(), "!" in w, marks / len(w), marks > 2, odd, disguised, stretched])
        n = max(len(words), 1)
        rate = lambda j: sum(x[j] for x in rows) / n
        near_you = sum(t and any(s and abs(i - j) <= toxicity.NEAR for j, s in enumerate(second)) for i, t in enumerate(toxic)) / n
        want.append([*(rate(j) for j in range(5)), sum(toxic) / n, np.log1p(sum(toxic)), near_you, *(rate(j) for j in range(5, 13)), np.log1p(len(words))])
    assert np.allclose(toxicity.features(pa.array(texts), toxicity.Words(lexicon)), np.array(want, dtype=float), atol=1e-6)


def quality_by_hand(texts, own):
    """Vectors by word and pooled features, by plain loops."""
    from corpusflow.llm.text import word_hashes

    hashes = {w: word_hashes(pa.array([w]), marks=True)[0] for t in texts for w in (t or "").split()}
    name = {w: w if w in own else int(h[0]) % quality.SHARED for w, h in hashes.items()}
    total, seen = {}, {}
    for t in texts:
        words = (t or "").split()
        for i, one in enumerate(words):
            for j, other in enumerate(words):
                if i != j and abs(i - j) <= quality.WINDOW:
                    (places,), (signs,) = quality.index_vectors(hashes[other])
                    v = total.setdefault(name[one], np.zeros(quality.WIDTH))
                    for p, s in zip(places, signs):
                        v[p] += s
                    seen[name[one]] = seen.get(name[one], 0) + 1
    mean = sum(total.values()) / sum(seen.values())
    vectors = {n: (v / seen[n] - mean) / np.linalg.norm(v / seen[n] - mean) for n, v in total.items()}
    features = []
    for t in texts:
        x = [vectors.get(name[w], np.zeros(quality.WIDTH)) for w in (t or "").split()]
        features.append([*np.mean(x, axis=0), *np.std(x, axis=0), np.log1p(len(x))] if x else [0.0] * (2 * quality.WIDTH + 1))
    return np.array(features)


@pytest.mark.parametrize("most", [1 << 17, 20, 3, 0])
def test_quality_equals_brute_force(spark, most):
    r = random.Random(2)
    words = [word() + str(i) for i in range(60)]
    texts = [" ".join(r.choices(words, weights=[2 ** (i // 6) for i in range(60)], k=r.randint(1, 40))) for _ in range(50)] + ["", None, "alone"]
    count = {}
    for t in texts:
        for w in (t or "").split():
            count[w] = count.get(w, 0) + 1
    level = {w: int(np.floor(np.log2(n) * quality.STEPS)) for w, n in count.items()}
    fits = [c for c in set(level.values()) if sum(x >= c for x in level.values()) <= most]
    own = {w for w in level if fits and level[w] >= min(fits)}
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    known = quality.vocabulary(df, most)
    assert len(known.own) == len(own)
    got = quality.pooled(pa.array(texts), known, quality.word_vectors(df, known))
    assert np.allclose(got, quality_by_hand(texts, own), atol=1e-4)


def test_network_equals_plain_arithmetic():
    r = np.random.default_rng(4)
    x = r.normal(size=(400, 3))
    net = quality.Network().fit(x, (x[:, 0] * x[:, 1] > 0).astype(float))
    by_hand = [sum(max(0.0, sum((v[i] - net.shift[i]) / net.scale[i] * net.w[0][i, h] for i in range(3)) + net.w[1][h]) * net.w[2][h] for h in range(quality.HIDDEN)) + net.w[3][0] for v in x[:20]]
    assert np.allclose(net.logits(x[:20]), by_hand)
    assert ((net.logits(x) > 0) == (x[:, 0] * x[:, 1] > 0)).mean() > 0.9


def test_temperature():
    r = np.random.default_rng(1)
    z = r.normal(size=5000) * 2
    y = (r.random(5000) < 1 / (1 + np.exp(-z))).astype(float)
    assert abs(quality.temperature(3 * z, y) - 3) < 0.3


def test_trees_and_isotonic():
    r = np.random.default_rng(2)
    x = r.random((800, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    trees = BoostedTrees().fit(x[:400], y[:400])
    assert ((trees.score(x[400:]) > 0) == y[400:]).mean() > 0.95
    iso = Isotonic().fit(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    p = iso.probability(np.linspace(0, 5, 20))
    assert (np.diff(p) >= 0).all() and len(iso.at) == 3, "the two in the middle are pooled"


# ---- near duplicates ----


def variants(spark):
    docs, group, n = [], {}, 0
    for g in range(12):
        base = [word() for _ in range(rng.randint(60, 300))]
        for k in range([1, 2, 3, 40][g % 4]):
            words = list(base)
            for _ in range(k % 4):
                words[rng.randrange(len(words))] = word()
            docs.append((n, " ".join(words)))
            group[n] = g
            n += 1
    return docs, group


def test_near_groups_equal_brute_force(spark):
    docs, _ = variants(spark)
    shingles = {i: {tuple(t.split()[j : j + 3]) for j in range(len(t.split()) - 2)} for i, t in docs}
    name = {i: i for i, _ in docs}

    def find(i):
        while name[i] != i:
            i = name[i]
        return i

    for i, _ in docs:
        for j, _ in docs:
            if i < j and len(shingles[i] & shingles[j]) >= 0.6 * len(shingles[i] | shingles[j]):
                a, b = sorted((find(i), find(j)))
                name[b] = a
    rows = near.near_groups(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)).collect()
    assert {r["doc_id"]: r["rep_id"] for r in rows} == {i: find(i) for i, _ in docs}
    assert {r["doc_id"] for r in rows if r["keep"]} == {find(i) for i, _ in docs}


def test_copies_of_every_number(spark):
    one, two = sentence(80), sentence(80)
    df = spark.createDataFrame([(i, one if i % 2 else two) for i in range(3000)] + [(5000, sentence(80))], "doc_id bigint, text string")
    assert {r["doc_id"] for r in near.deduplicate(df).collect()} == {0, 1, 5000}


def test_near_odd_rows(odd, empty):
    rows = near.near_groups(odd).collect()
    assert len(rows) == 11, "rows without a number aren't compared"
    kept = near.deduplicate(odd)
    assert kept.columns == odd.columns
    found = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in kept.collect())
    assert [x for _, x, _ in found] == [1, 1, 3, 4, 5, 6, 7, 8, 9, 0, 0]
    assert near.near_groups(empty).count() == 0 and near.deduplicate(empty).count() == 0


def test_long_texts_that_share_little_stay(spark):
    r = np.random.default_rng(6)
    text = lambda common: " ".join([*common, *(f"w{x}" for x in r.integers(0, 1 << 40, 100_000 - len(common)))])
    few, many = [f"few{i}" for i in range(300)], [f"many{i}" for i in range(40_000)]
    docs = pa.record_batch({"doc_id": [0, 1], "text": [text(few), text(few)]})
    a, b = (x for part in near._sketch([docs]) for x in part.column("signature").to_pylist())
    (got,) = near._agreement([pa.record_batch({"a": [b"a"], "b": [b"b"], "sa": [a], "sb": [b]})])
    assert got.column("similarity")[0].as_py() < 0.1, got
    # of a similarity of 0.25, so that most meet as candidates
    df = spark.createDataFrame([(i, text(many)) for i in range(4)], "doc_id bigint, text string")
    assert {r["doc_id"] for r in near.deduplicate(df).collect()} == {0, 1, 2, 3}


def test_pairs_in_a_crowd_are_all_found(spark):
    """Texts on one template that are not near each other by themselves, with pairs among them that are."""
    local = random.Random(7)
    template = [word() for _ in range(70)]
    own = lambda n: [f"{word()}{local.randrange(10**9)}" for _ in range(n)]
    docs = []
    for i in range(400):
        words = template + own(60)
        docs.append((2 * i, " ".join(words)))
        docs.append((2 * i + 1, " ".join(words[:110] + own(20) if i % 4 == 0 else template + own(60))))
    shingles = {i: {tuple(t.split()[j : j + 3]) for j in range(len(t.split()) - 2)} for i, t in docs}
    share = lambda i, j: len(shingles[i] & shingles[j]) / len(shingles[i] | shingles[j])
    assert share(0, 1) > 0.65 and 0.33 < share(0, 2) < 0.42
    # signatures estimate similarities; the threshold lies between the crowd's and the pairs' by several deviations
    rows = near.near_groups(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4), 0.57).collect()
    assert {(r["doc_id"], r["rep_id"]) for r in rows} == {(i, i - (i % 8 == 1)) for i, _ in docs}
    assert {r["doc_id"]: r["links"] for r in rows} == {i: int(i % 8 in (0, 1)) for i, _ in docs}


def test_rest_is_what_neighbours_miss(spark, monkeypatch):
    """Without neighbours, the comparison of groups within regions finds the same groups."""
    docs, _ = variants(spark)
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    want = {r["doc_id"]: r["rep_id"] for r in near.near_groups(df).collect()}
    monkeypatch.setattr(near, "BLOCK", 8)
    monkeypatch.setattr(near, "REACH", 0)
    monkeypatch.setattr(near, "candidate_pairs", lambda vertices: vertices.sparkSession.createDataFrame([], "a binary, b binary"))
    assert {r["doc_id"]: r["rep_id"] for r in near.near_groups(df).collect()} == want


@pytest.mark.parametrize("words", [20_000, 200_000])
def test_very_long_texts_equal_brute_force(spark, words):
    """Documents of which 0, 40 and 90 % are common: only the last pair is near."""
    r = np.random.default_rng(words)
    own = lambda n: [f"w{x}" for x in r.integers(0, 1 << 40, n)]
    base = own(words)
    docs = [(0, base), (1, own(words)), (2, base[: words * 2 // 5] + own(words * 3 // 5)), (3, base[: words * 9 // 10] + own(words // 10))]
    rows = near.near_groups(spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: (r["rep_id"], r["links"]) for r in rows} == {0: (0, 1), 1: (1, 0), 2: (2, 0), 3: (0, 1)}


# ---- secrets ----


@pytest.fixture(scope="module")
def scanner():
    return secrets.train()


def test_every_format_is_found_and_words_are_not(scanner):
    fresh = secrets.examples(150, seed=99)
    for name, strings in fresh.items():
        if name == secrets.PRIVATE:
            strings = [s.replace("_", " ") for s in strings]
        found = [scanner.scan(f"the secret value {s} follows") for s in strings]
        hit = sum(bool(f) for f in found) / len(found)
        # among "word" are runs of random capitals, which a run of base64 can look like
        assert hit < 0.025 if name == "word" else hit > 0.97, (name, hit)


@pytest.mark.parametrize("form", ["API_KEY={}", "export KEY={};", "https://x.org/a?access_token={}&b=1", "backup/keys/{}", "https://x.org/keys/{}/info", "https://{}@x.org/a", "+{}", "- -{}", "a.b={}é", "config.{}"])
def test_parts_of_runs(scanner, form):
    plain = form
    for name, strings in secrets.examples(60, seed=98).items():
        form = f"secret {plain}" if name.startswith("hex_") else plain
        before = form.index("{}")
        if name not in ("word", secrets.PRIVATE):
            strings = strings if not form.endswith("a.b={}é") else [s + "/" for s in strings]
            found = scanner.scan_all([form.format(s) for s in strings])
            same = [any((a, n) == (before, len(s.rstrip("/"))) for a, n, *_ in f) for f, s in zip(found, strings)]
            assert sum(same) > 0.93 * len(same), (name, sum(same))


def test_hashes_are_no_secrets_unless_named(scanner):
    r = random.Random(3)
    digits = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    for n in (32, 40, 64):
        for form in ("commit {}", "see {} for the change", "md5: {}", "sha256:{}", "the key's checksum {}", "ETag: \"{}\"", "https://x.org/tree/{}"):
            assert not scanner.scan(form.format(digits(n))), (form, n)
        for form in ("api_key={}", "secret: {}", "token = \"{}\"", "the password is {}", "Authorization: Bearer {}"):
            x = digits(n)
            assert [(a, m) for a, m, *_ in scanner.scan(form.format(x))] == [(form.index("{}"), n)], (form, n)


def test_private_keys_reach_to_their_last_line(scanner):
    r = random.Random(4)
    lines = ["".join(r.choice(secrets._alnum + "+/") for _ in range(64)) for _ in range(4)]
    for kind in ("RSA ", "", "OPENSSH "):
        key = f"-----BEGIN {kind}PRIVATE KEY-----\n" + "\n".join(lines) + f"==\n-----END {kind}PRIVATE KEY-----"
        assert [x[:3] for x in scanner.scan(f"before\n{key}\nafter")] == [(7, len(key), secrets.PRIVATE)]
        cut = key[: key.index("==") + 2]
        assert [x[:3] for x in scanner.scan(cut + "\n\n(cut off)")] == [(0, len(cut), secrets.PRIVATE)]
    assert not scanner.scan("-----BEGIN PUBLIC KEY-----\nabc\n-----END PUBLIC KEY-----")


def test_likelihoods_equal_brute_force(scanner):
    """Every candidate span of texts of all kinds, walked symbol by symbol through every automaton."""
    r = random.Random(6)
    for _, strings in secrets.examples(4, seed=95).items():
        text = "x=" + r.choice("/-.").join(strings)
        for a, lengths in secrets.candidates(text, scanner.reach):
            got = scanner.likelihoods([text[a : a + lengths[-1]]], [lengths])
            for k, (to, log, end) in enumerate(scanner.tables):
                for col, n in enumerate(lengths):
                    state, total = 0, 0.0
                    for c in text[a : a + n]:
                        x = ord(c) - secrets.FIRST
                        total, state = total + log[state, x], to[state, x]
                    assert abs(got[k, col] - (total + end[state]) / (n + 1)) < 1e-9


def test_words_paths_and_long_base64_are_no_secrets(scanner):
    r = random.Random(8)
    blob = "".join(r.choice(secrets._alnum + "+/") for _ in range(20_000))
    assert len(scanner.scan(f"data:image/png;base64,{blob}==")) <= 2
    words = [w for w in secrets.examples(300, seed=97)["word"] if w.isalpha()]
    texts = [f"https://x.org/{a.lower()}/{b.lower()}.html?page={c}" for a, b, c in zip(words, words[1:], words[2:])]
    assert sum(map(bool, scanner.scan_all(texts))) < 0.025 * len(texts)


def test_scan_and_redact(spark, scanner):
    key = "AKIA" + "Q2W3E4R5T6Y7U2I3"
    df = spark.createDataFrame([(1, f'é key="{key}" and {key}.', 0), (2, "nothing here", 0)], "doc_id bigint, text string, n_chars bigint")
    rows = secrets.findings(df, scanner).collect()
    assert [(r["doc_id"], r["position"], r["length"], r["format"]) for r in rows] == [(1, 7, 20, "aws_access_key"), (1, 33, 20, "aws_access_key")]
    clean = {r["doc_id"]: r for r in secrets.redact(df, scanner).collect()}
    assert clean[1]["text"] == 'é key="[SECRET]" and [SECRET].' and clean[1]["n_chars"] == len(clean[1]["text"]) and clean[2]["text"] == "nothing here"


def test_secrets_odd_rows(odd, empty, scanner):
    assert secrets.findings(odd, scanner).count() == 0 and secrets.findings(empty, scanner).count() == 0
    same = secrets.redact(odd, scanner)
    assert same.columns == odd.columns and sorted(map(repr, same.drop("n_chars").collect())) == sorted(map(repr, odd.drop("n_chars").collect()))
    assert secrets.redact(empty, scanner).count() == 0


def test_inference_merges_and_keeps_lengths():
    r = random.Random(5)
    fixed = Automaton.infer([[r.randrange(4) for _ in range(10)] for _ in range(500)])
    assert len(fixed.count) == 11, "a format of ten symbols is a chain of eleven states"
    to, log, end = fixed.tables(5)

    def likelihood(x):
        state, total = 0, 0.0
        for s in x:
            total += log[state, s]
            state = to[state, s]
        return (total + end[state]) / (len(x) + 1)

    good = likelihood([1, 2, 3, 0, 1, 2, 3, 0, 1, 2])
    assert good > likelihood([1, 2, 3]) + 0.5 and good > likelihood([1, 2, 4, 0, 1, 2, 3, 0, 1, 2]) + 0.5
    loop = Automaton.infer([[0] * (1 + int(r.expovariate(0.3))) for _ in range(2000)])
    assert len(loop.count) < 6, "repetition becomes a loop"
