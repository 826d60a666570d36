"""The training-data operators against brute force, on small fixtures with odd rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from seasonloom.llm import bpe, html, langid, mixing, neardup, neighbours, quality, rules, secrets, toxicity

VOCAB = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, score double"
SYLLABLES = "the er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()


def word(rng):
    return "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4)))


def prose(rng, n):
    return " ".join(word(rng) for _ in range(n))


def documents(spark, rows):
    """Documents from (doc_id, text, source), with columns whose names operators use themselves."""
    return spark.createDataFrame([(d, t, "en", s, len(t) if t else None, "x", 0.5) for d, t, s in rows], SCHEMA)


ODD = [(900, None, None), (901, "", "s1"), (902, "one", "s1"), (903, "A b c", "s2"), (904, "a B C", "s2"), (905, " \n\t ", None), (None, "nobody has an id here at all", "s3"), (906, "é ü 日本 😀 <|endoftext|> token", "s1")]


def corpus(rng, n=60):
    rows = [(k, prose(rng, rng.randint(5, 120)), f"s{k % 3}") for k in range(n)]
    base = prose(rng, 100)
    for k in range(40):  # a group of near copies
        w = base.split()
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = word(rng)
        rows.append((100 + k, " ".join(w), "s0"))
    rows += [(200 + k, rows[3][1].upper() if k % 2 else rows[3][1], "s1") for k in range(10)]  # copies
    return rows + [rows[5], rows[5]] + [(300, prose(rng, 20000), "s2")]  # repeated rows, a long text


def brute_components(rows):
    sets = []
    for d, t, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) > 3 else {tuple(w)} if w else set())
    label = list(range(len(rows)))

    def root(a):
        while label[a] != a:
            a = label[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                label[max(root(i), root(j))] = min(root(i), root(j))
    groups = defaultdict(list)
    for i, (d, _, _) in enumerate(rows):
        groups[root(i)].append(d)
    return sorted((d, len(s), min((x for x in groups[root(i)] if x is not None), default=None)) for i, ((d, _, _), s) in enumerate(zip(rows, sets)) if d is not None)


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(1)
    rows = corpus(rng) + ODD
    found = neardup.deduplicate(documents(spark, rows)).collect()
    assert len(found) == len(rows)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found if r.doc_id is not None) == brute_components(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found if r.doc_id is not None)


def test_large_nodes_branch_and_lose_nothing(spark, monkeypatch):
    rng = random.Random(2)
    monkeypatch.setattr(neardup, "LEAF", 6)
    monkeypatch.setattr(neardup, "FEW", 2)
    monkeypatch.setattr(neardup, "DEPTH", 3)
    rows = corpus(rng)
    found = neardup.deduplicate(documents(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute_components(rows)


def test_near_duplicates_of_nothing(spark):
    assert neardup.deduplicate(documents(spark, [])).count() == 0


def test_neighbours_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.standard_normal(16)], 0) for i in range(400)]
    rows += [(i, rows[0][1], 0) for i in range(400, 460)] + [(1000, None, 0), (1020, [0.0] * 16, 0), (1040, [float("nan")] * 16, 0), (1060, [], 0), (1080, [1.0, None], 0), (1100, [1.0, 2.0], 0), (None, rows[1][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    found = neighbours.search(df, df.where("vec_id % 20 = 0"), 20, data_rows=100, query_rows=10).collect()
    x = {i: np.array(v, dtype=np.float32).astype(float) for i, v, _ in rows[:460]}
    got, hit, total = defaultdict(list), 0, 0
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == {i for i in x if i % 20 == 0}
    for q, near in got.items():
        want = sorted(((i, float((x[i] * x[q]).sum())) for i in x if i != q), key=lambda p: (-p[1], p[0]))[:20]
        hit, total = hit + len({i for i, _ in want} & {i for i, _ in near}), total + 20
        assert near == sorted(near, key=lambda p: (-p[1], p[0])) and len(near) == 20
        assert all(abs(s - float((x[i] * x[q]).sum())) < 1e-12 for i, s in near)
    assert hit / total >= 0.9


PATTERNS = {"assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I, 2, 8), "access": (r"AKIA[A-Z0-9]+", 0, 0, 16), "hex": (r"[0-9a-f]+", 0, 0, 32)}


def brute_spans(text):
    spans = []
    for place, (kind, (pattern, flags, group, least)) in enumerate(PATTERNS.items()):
        spans += [(m.start(), place, m.end(), kind) for m in re.finditer(pattern, text or "", flags) if len(m[group]) >= least]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))


def test_secrets_equal_patterns_and_find_random_tokens(spark):
    rng = random.Random(3)
    key = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(48))
    texts = ["😀 PassWord = 'abcdefgh12' and token:short", "token:secret:abcdefghijk", "AKIA" + "A" * 11 + " AKIAAKIA0123456789", "f" * 31 + "g" + "0123456789abcdef" * 3, "api_key==x=yz12345678 ApiKey: \"q.w-e_r+t/y\"", f"here {key} ends", f"token={key}", "thequickbrownfoxjumpsoverthelazydogandmore", "", None, "a" * 70, "0123456789" * 5]
    texts += [prose(rng, 50) + " " + "".join(word(rng) for _ in range(14)) for _ in range(60)]
    rows = [(k, t, None) for k, t in enumerate(texts)]
    found = {r.doc_id: r.spans for r in secrets.scan(documents(spark, rows)).collect()}
    for k, t in enumerate(texts):
        assert ",".join(f"{s.kind}:{s.start}:{s.end}" for s in found[k] if s.kind != "random") == brute_spans(t), t
        for s in found[k]:
            assert (t or "")[s.start : s.end] == s.token
    assert [s.kind for s in found[5]] == ["random"] and found[5][0].token == key
    assert [s.kind for s in found[6]] == ["assign"]
    assert not any(found[k] for k in (7, 8, 9)) and not any(found[k] for k in range(12, len(texts)))
    clean = {r.doc_id: r.text for r in secrets.redacted(documents(spark, rows)).collect()}
    assert clean[5] == "here <random> ends" and clean[9] is None and clean[12] == texts[12]
    assert secrets.scan(documents(spark, [])).count() == 0


def test_secrets_of_sixteen_characters(spark):
    rng = random.Random(11)
    keys = ["".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(20)) for _ in range(30)]
    rows = [(k, f"here {t} ends", None) for k, t in enumerate(keys)] + [(k, prose(rng, 20) + " " + "".join(word(rng) for _ in range(6)), None) for k in range(100, 200)]
    found = {r.doc_id: [s.kind for s in r.spans] for r in secrets.scan(documents(spark, rows)).collect()}
    assert sum(found[k] == ["random"] for k in range(30)) >= 28 and not any(found[k] for k in range(100, 200))


def test_uniformity_guard_spares_long_random_tokens(spark):
    rng = random.Random(12)
    pick = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    kinds = {"prefixed": lambda: "key-" + pick(lower + digits, 100), "grouped": lambda: "-".join(pick(digits + "ABCDEF", 8) for _ in range(8)), "long": lambda: pick(lower + upper + digits, 2500)}
    rows = [(kind, make()) for kind, make in kinds.items() for _ in range(30)] + [("sequence", (lower + digits) * 2), ("sequence", digits * 5)]
    tested = secrets.battery(spark.createDataFrame(rows, "kind string, token string")).collect()
    passed = Counter(r.kind for r in tested if r.uniform_p >= secrets.UNIFORM_P)
    assert all(passed[kind] == 30 for kind in kinds) and not passed["sequence"]


def test_language_id_with_unseen_words(spark):
    rng = random.Random(4)
    parts = {"en": "the and ing tion with that er on".split(), "de": "der und sch ung mit das ein en".split(), "fr": "le la que eau ment avec des ou".split()}
    text = lambda lang, n: " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    rows = [(k, text(lang, 30), lang) for k, lang in enumerate(list(parts) * 40)]
    docs = spark.createDataFrame(rows + [(500, None, "en"), (501, "12 !?", "de"), (502, "", None), (503, "Schungdermitschung", None), (None, "the", None)], "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in langid.identify(docs).collect()}
    held = [r for r in found.values() if r.held_out and r.doc_id is not None and r.doc_id < 500]
    assert len(held) > 10 and all(found[k].lang_pred == lang for k, _, lang in rows)
    assert [found[k].lang_pred for k in (500, 501, 502, 503)] == ["und", "und", "und", "de"]
    assert all(0 <= r.score <= 1 for r in found.values())
    none = langid.identify(spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")).first()
    assert none.lang_pred == "und" and none.score == 0


def test_bpe_equals_the_tokenizers_library(spark):
    from tokenizers import Tokenizer

    truth = Tokenizer.from_file(VOCAB)
    rng = random.Random(5)
    texts = [None, "", " ", "a" * 300, "aaa <|endoftext|> b", "I'll  don't\n\n x ", "\x1cx\x85y　z", "日本語 😀é", "  lead", "trail  ", prose(rng, 3000)]
    texts += ["".join(rng.choice("aabcdehhhtt  ei'.,!!#09\n\tßé日😀") for _ in range(40)) for _ in range(300)]
    found = {r.doc_id: r for r in bpe.encode_documents(documents(spark, [(k, t, None) for k, t in enumerate(texts)]), VOCAB).collect()}
    for k, t in enumerate(texts):
        ids = truth.encode(t or "", add_special_tokens=False).ids
        assert found[k].ids == ids, t
        assert found[k].decoded == truth.decode(ids, skip_special_tokens=False)


def marked(rng, n, quality_):
    return prose(rng, n) if quality_ else prose(rng, n).upper().replace(" ", "!! ")


def test_language_id_drops_the_automaton_of_its_worker(spark):
    docs = documents(spark, [(k, f"plain words {k}", "s") for k in range(20)]).coalesce(1)

    def size(frames):
        import gc

        for frame in frames:
            yield frame.assign(id=sum(type(x).__name__ == "MergeAutomaton" for x in gc.get_objects()))

    held = lambda: spark.range(1).coalesce(1).mapInPandas(size, "id long").first()[0]
    for _ in range(3):  # more than one worker may be idle
        bpe.encode_documents(docs, VOCAB).collect()
    model = langid.train(docs)
    for _ in range(8):
        langid.predict(docs, model).collect()
    assert [held() for _ in range(4)] == [0] * 4


def test_quality_and_rules_on_held_out_rows(spark):
    rng = random.Random(6)
    rows = [(k, marked(rng, 60, k % 3 > 0), None) for k in range(300)] + [(900, None, None), (901, "", None), (902, "short text", None)]
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(300)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    docs = documents(spark, rows)
    found = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    held = [r for r in found.values() if r.held_out and r.doc_id < 300]
    assert sum(r.predicted == int(r.doc_id % 3 > 0) for r in held) / len(held) >= 0.95
    assert all(0 <= r.score <= 1 for r in found.values()) and len(found) == len(rows)
    kept = {r.doc_id: r for r in rules.classify(docs, labels).collect()}
    assert sum(kept[k].kept == (k % 3 > 0) for k in range(300)) >= 290
    assert not any(kept[k].kept for k in (900, 901, 902))
    bare = quality.classify(docs, labels.where("false")).first()
    assert bare.score == 0.5


def test_rule_figures_equal_brute_force(spark):
    rng = random.Random(7)
    texts = [None, "", "a b\na b\n\n \n c#$ <|>", "x " * 30, "\n".join([prose(rng, 12)] * 4), "é" * 9 + "\r\n" + "é" * 9, prose(rng, 5000)]
    texts += ["\n".join(rng.choice(["a b c d e f g h i", "q # r", " ", "", prose(rng, 9)]) for _ in range(12)) for _ in range(40)]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = {r.doc_id: r for r in rules.classify(documents(spark, [(k, t, None) for k, t in enumerate(texts)]), labels).collect()}
    for k, t in enumerate(texts):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        times, cover, seen, dup = Counter(windows), set(), set(), 0
        for i, x in enumerate(windows):
            if times[x] > 1:
                cover.update(range(i, i + 8))
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        r = found[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(cover)), t
        assert r.base_failed == (len(w) < 20 or 100 * len(cover) > 30 * len(w))


def test_rule_weights_of_long_documents_do_not_depend_on_direction():
    import pickle

    rng = random.Random(13)
    texts = [[f"{prose(rng, 1 + k % 5)} {k}" if k < 200 + 20 * label else f"{k} !! ## {k}" for k in range(300)] for label in (0, 1)]
    model = lambda turn: pickle.loads(rules.fit([(k, "\n".join(t[::turn]), k) for k, t in enumerate(texts)]))
    (emit, step, _), (emit2, step2, _) = model(1), model(-1)
    assert np.allclose(emit, emit2, atol=1e-6) and np.allclose(step, step2.T, atol=1e-6)


def test_viterbi_equals_enumeration():
    from itertools import product

    rng = np.random.default_rng(1)
    for _ in range(30):
        scores, step = rng.normal(size=6).tolist(), rng.normal(size=(2, 2)).tolist()
        value = lambda y: sum(s for s, k in zip(scores, y) if k) + sum(step[a][b] for a, b in zip(y, y[1:]))
        assert value(rules.decode(scores, step)) == pytest.approx(max(map(value, product((0, 1), repeat=6))))


def test_toxicity_index_is_exact_and_catches_marked_documents(spark):
    rng = random.Random(8)
    bad = ["zorgle", "frobnak", "quibbus"]
    rows = [(k, prose(rng, 40) + (" " + rng.choice(bad) + " " + rng.choice(bad) if k % 5 == 0 else ""), None) for k in range(600)]
    labels = spark.createDataFrame([(k, 1, int(k % 5 == 0)) for k in range(600)], "doc_id long, quality int, toxic int")
    found = {r.doc_id: r for r in toxicity.classify(documents(spark, rows + [(900, None, None), (901, "", None)]), labels).collect()}
    assert all(found[k].predicted == int(k % 5 == 0) for k in range(600))
    assert found[900].score < 0.5 and found[0].evidence
    gen = np.random.default_rng(0)
    vectors = []
    for _ in range(300):
        v = {int(w): float(x) for w, x in zip(gen.choice(20, 4, replace=False), gen.random(4) + 0.1)}
        norm = sum(x * x for x in v.values()) ** 0.5
        vectors.append({w: x / norm for w, x in v.items()})
    index = toxicity.BlockMaxIndex(vectors, 16)
    for q in vectors[:40]:
        brute = sorted((-round(sum(x * v.get(w, 0) for w, x in q.items()), 12), e) for e, v in enumerate(vectors) if q.keys() & v.keys())[:10]
        got = index.nearest(q, 10)
        assert [e for _, e in got] == [e for _, e in brute]
    none = toxicity.classify(documents(spark, rows[:3]), labels.where("false"))
    assert none.agg(F.max("score")).first()[0] == 0


def test_toxicity_finds_copies_without_associated_words(spark):
    rng = random.Random(9)
    rows = [(k, prose(rng, 40) + (" zorgle quibbus" if k % 5 == 0 and k != 35 else ""), int(k % 5 == 0)) for k in range(400)]
    docs = documents(spark, [(900, rows[35][1], None), (901, rows[36][1], None), (902, "", None)])
    found = {r.doc_id: r for r in toxicity.score(docs, toxicity.fit(rows)).collect()}
    assert [(found[k].evidence[0].doc_id, round(found[k].evidence[0].cosine, 9), found[k].evidence[0].toxic_share) for k in (900, 901)] == [(35, 1.0, 1.0), (36, 1.0, 0.0)]
    assert not found[902].evidence


def test_min_cut_equals_enumeration():
    from itertools import product

    rng = np.random.default_rng(2)
    for _ in range(40):
        odds = rng.normal(size=6).tolist()
        edges = {(a, b): float(rng.random()) for a in range(6) for b in range(a + 1, 6) if rng.random() < 0.5}
        cost = lambda y: sum(x for x, k in zip(odds, y) if x > 0 and not k) + sum(-x for x, k in zip(odds, y) if x < 0 and k) + sum(w for (a, b), w in edges.items() if y[a] != y[b])
        assert cost(html.min_cut(odds, edges)) == pytest.approx(min(map(cost, product((False, True), repeat=6))))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<div class="cookie-notice"><p>We use cookies.</p></div><header><h1>Site</h1><nav><ul><li><a href="/a">A</a></ul></nav></header>
<article><h1>Head</h1><p><b>First &amp; foremost,<br>a sentence that is long enough.<p>Second   one, <a href=x>linked</a> in part, with much more text.</article>
<aside><p>Related reading with a good deal of text in it, really.</p></aside><div class="comments"><p>Nice article, I liked it very much indeed.</p></div><form>Mail <input></form><footer>&copy; 2020</footer></body></html>"""


def test_html_extraction(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "plain text"), (5, "u", "<p>a<p>b"), (6, "u", "<<<>>&&amp;<p"), (None, "u", "<div>" * 2000 + "deep")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    found = {r.page_id: r for r in html.extract(pages).collect()}
    assert found[1].text == "Head\nFirst & foremost, a sentence that is long enough.\nSecond one, linked in part, with much more text."
    assert found[2].text == found[3].text == "" and found[4].text == "plain text" and found[5].text == "a\nb" and found[None].text == "deep"
    assert all(r.n_chars == len(r.text) for r in found.values())


def test_mixing_meets_targets_and_limits(spark):
    rng = random.Random(9)
    rows = [(k, prose(rng, rng.randint(1, 300)), rng.choice(["b", "b", "b", "a", "c", None])) for k in range(400)] + [(7, "again again", "b"), (7, "again again", "b"), (800, None, "a"), (801, "", "z"), (None, "x y", "a")]
    docs = documents(spark, rows)
    found = mixing.taken_words(docs, block_words=16, shard_slots=64).toPandas()
    assert len(found) == len(rows) and (found.taken <= 2 * found["size"]).all()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        left, open_ = left - sum(target[s] for s in over), open_ - over
    assert sorted(set(found.target.round(6))) == sorted({round(t, 6) for t in target.values()})
    by = found.groupby("source_size").agg(taken=("taken", "sum"), target=("target", "first"))
    assert ((by.taken - by.target).abs() <= 40).all()
    again = mixing.taken_words(docs.repartition(7), block_words=16, shard_slots=64).toPandas()
    key = lambda f: sorted(map(tuple, f[["doc_id", "size", "taken"]].fillna(-1).to_numpy().tolist()))
    assert key(found) == key(again)
    mixed = mixing.mixed_documents(docs, block_words=16, shard_slots=64)
    assert mixed.columns == docs.columns
    assert mixed.select(F.sum(mixing.word_count(F.col("text")))).first()[0] == found.taken.sum()
    assert mixing.taken_words(documents(spark, [])).count() == 0


@pytest.mark.parametrize("made", [mixing.mixed_documents, mixing.taken_words])
def test_mix_never_broadcasts_its_slots(spark, made):
    rng = random.Random(11)
    found = made(documents(spark, [(k, prose(rng, 40), f"s{k % 3}") for k in range(60)]), block_words=16)
    assert found.collect()
    joins = [x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Join [" in x and "block#" in x]
    assert joins and not any("Broadcast" in x for x in joins)


def test_permutation_is_one(spark):
    for n in (1, 2, 3, 17, 1000):
        df = spark.range(n).select(F.col("id").alias("j"), F.lit(n).cast("long").alias("n"), F.lit("s").alias("source"))
        assert sorted(r.block for r in mixing.permuted(df, "j", "n", ["source"], 9).collect()) == list(range(n))


def test_pipeline_stages(spark):
    import corpus_pipeline

    rng = random.Random(10)
    docs = documents(spark, corpus(rng, 30) + ODD + [(950, "password: hunter2hunter2 and some more words here", "s1")])
    columns, at = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [(r.doc_id, r.text, r.source) for r in at.collect()]
        at = spark.createDataFrame(stage(spark, at, "").collect(), at.schema)
        assert at.columns == columns, name
        ids = [r.doc_id for r in at.collect()]
        if name == "language_id":
            assert 905 not in ids and 901 not in ids and 900 not in ids and 902 in ids
        if name == "near_duplicates":
            assert len(set(ids)) == len(ids) < len(before)
            assert sorted(d for d in ids if d is not None) == sorted({c for _, _, c in brute_components(before)})
        if name == "secret_scans":
            assert at.where("doc_id = 950").first().text == "<assign> and some more words here"
    tokens = corpus_pipeline.STAGES[-1][1](spark, at, "")
    assert tokens.count() == at.count() and tokens.where("n_tokens = size(ids)").count() == at.count()


def test_pipeline_decodes_its_ids(spark):
    import corpus_pipeline

    texts = ["plain words", "größer 😀  two\n", "", None]
    found = {r.doc_id: r for r in corpus_pipeline.tokens(spark, documents(spark, [(k, t, None) for k, t in enumerate(texts)]), "").collect()}
    assert all(found[k].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest() for k, t in enumerate(texts))


def test_digests_of_no_spans():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
