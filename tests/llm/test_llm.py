"""The ten operators against brute force on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import base64
import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers as pt
from strandix.llm import bpe, chat, decontaminate, html_extract, language_id, line_dedup, ngram_join, quality, sharding, token_counts
from strandix.llm.components import components
from strandix.llm.html_labelled import MARK, labelled_pages

SPACES = r"[^\x20\x09-\x0D]+"
PATH = pt.path("byte_bpe_50k.tiktoken")


def rows(df):
    return [tuple(r) for r in df.collect()]


VOCAB = [a + b for a in ("ka", "lo", "mi", "tu", "re", "so", "vu", "ne") for b in ("ra", "st", "on", "ei", "ul", "an")]


def prose(r, n):
    return " ".join(r.choice(VOCAB) for _ in range(n))


#: Names that operators use for columns of their own, now or before.
CLASHING = "row q w t n s m x l g h r d2 det kept salt level lng src id sha n_lines n_dropped n_tokens ids_sha256 text_in gone bad k1 k2 shard slot __slot sid comp bits token __q __id __text __w _gone component_id n_shingles item_id hot_id copies rep".split()


@pytest.fixture(scope="module")
def docs(spark):
    """Rows with every awkward case, and columns whose names clash with those that operators add."""
    r = random.Random(11)
    line = "A line that very many documents share, as footers are."
    base = prose(r, 120)
    texts = [None, "", " \n\t ", "one", "two words", "é", "Ünï çødé ☃   x"]
    texts += [prose(r, n) for n in (3, 49, 50, 51, 200)] * 2
    texts += [prose(r, 60) + "\n" + line.upper() + "\n" + prose(r, 5) for _ in range(5)]
    texts += [base, base, base + " tail", base.replace(" ", "  "), base.upper()]
    texts += [" ".join(w if i % 40 else w + "x" for i, w in enumerate(base.split())), "spam " * 90, "a" * 3000, prose(r, 9000), "$$ ## " * 60]
    data = [(i, t, ["en", None, "de"][i % 3], ["s", None][i % 2], 0, "kept", 1) for i, t in enumerate(texts)]
    data += [data[20], (None, "null id " + line, "en", "s", 0, "kept", 1)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, keys string, n_words int").withColumns({c: F.lit("kept") for c in CLASHING}).persist()


def empty(docs):
    return docs.limit(0)


# -- 1


def test_sharding_fills_in_turns():
    names = [f"s{i}" for i in range(7)]
    got = sharding.fill(names, 101)
    orders = [[(sharding._draw(n, "offset", 101) + k * (sharding._draw(n, "skip", 100) + 1)) % 101 for k in range(101)] for n in names]
    want, turn = [None] * 101, 0
    while None in want:
        slot = next(s for s in orders[turn % 7] if want[s] is None)
        want[slot] = turn % 7
        turn += 1
    assert got == want
    counts = np.bincount(got)
    assert counts.max() - counts.min() <= 1
    fewer = sharding.fill(names[:-1], 101)
    assert sum(a != b for a, b in zip(got, fewer)) < 101 / 7 + 30
    with pytest.raises(ValueError):
        sharding.fill(names, 100)


def test_placement(spark, docs):
    names = [f"s{i}" for i in range(5)]
    lookup = sharding.lookup_table(spark, names, 101)
    got = sharding.place(docs, "doc_id", lookup, 101)
    filled = sharding.fill(names, 101)
    for r in got.collect():
        slot = int(hashlib.md5(("" if r["doc_id"] is None else str(r["doc_id"])).encode()).hexdigest()[:15], 16) % 101
        assert (r["___slot"], r["__shard"], r["__slot"]) == (slot, names[filled[slot]], "kept")
    assert got.count() == docs.count() and sharding.place(empty(docs), "doc_id", lookup, 101).count() == 0
    assert got.select("__slot").schema and set(docs.columns) < set(got.columns)
    spread = sharding.place(docs.withColumn("k", F.lit("hot")), "k", lookup, 101, spread=64, spread_by="doc_id")
    assert spread.select("__shard").distinct().count() > 2


def test_write_shards(spark, docs, tmp_path):
    sharding.write_shards(docs, "doc_id", ["a", "b"], str(tmp_path / "o"), 11)
    assert spark.read.parquet(str(tmp_path / "o")).count() == docs.count()


# -- 2


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(1)
    e, trans = rng.random((2, 4, 3)) + 0.1, rng.random((3, 3)) + 0.1
    valid = np.array([[True] * 4, [True, True, False, False]])
    e[1, 2:] = 1.0
    m, _, _ = language_id.forward_backward(e, valid, trans)
    for s, n in ((0, 4), (1, 2)):
        want = np.zeros((n, 3))
        for path in np.ndindex(*[3] * n):
            p = np.prod([e[s, i, k] for i, k in enumerate(path)]) * np.prod([trans[a, b] for a, b in zip(path, path[1:])])
            for i, k in enumerate(path):
                want[i, k] += p
        assert np.allclose(m[s, :n], want / want.sum(1, keepdims=True))


def test_a_text_is_one_chain():
    rng = np.random.default_rng(6)
    lab = language_id.Labeller(language_id.Model(["a", "b", "c"], [], rng.normal(0, 0.3, (language_id.TABLE, 3)), rng.normal(0, 1, (3, 3))))
    names = ["".join(rng.choice(list("xyzuvw"), 3)) for _ in range(50)]
    texts = [" ".join(rng.choice(names, n)) for n in (1, 63, 64, 65, 400, 128, 2, 1000)]
    words, got, text = lab.marginals([*texts, ""])
    trans = np.exp(lab.model.trans)
    for k, t in enumerate(texts):
        e = lab.table[lab._potentials(t.split())].astype(np.float64)
        want, _, _ = language_id.forward_backward(e[None], np.ones((1, len(e)), bool), trans)
        assert np.allclose(got[text == k], want[0], atol=1e-4)


def test_language_labels(spark):
    r = random.Random(2)
    speak = {"aa": ["thinor", "erth", "stion", "whand"], "bb": ["queau", "ément", "oirè", "leux"]}
    say = lambda la, n: " ".join(r.choice(speak[la]) + r.choice(["", "s", "en"]) for _ in range(n))
    model = language_id.Model.fit([(say(la, 80), la) for la in speak for _ in range(40)], rounds=30, sequences=300)
    lab = language_id.Labeller(model)
    lang, score = lab.predict([say("aa", 50), say("bb", 9), None, "", "123 !?", say("aa", 30) + " " + say("bb", 5), say("bb", 5000)])
    assert lang == ["aa", "bb", "und", "und", "und", "aa", "bb"] and score[2:5].tolist() == [0, 0, 0] and ((score >= 0) & (score <= 1)).all()
    words, m, _ = lab.marginals([say("aa", 20) + " " + say("bb", 20)])
    got = [model.langs[k] for k in m.argmax(1)]
    assert sum(g == ("aa" if i < 20 else "bb") for i, g in enumerate(got)) >= 38
    df = spark.createDataFrame([(1, say("aa", 5), "x"), (1, say("aa", 5), "x"), (None, None, None)], "doc_id long, text string, score string")
    assert sorted(x[1] for x in rows(language_id.label_documents(df, model))) == ["aa", "aa", "und"]
    assert language_id.Labeller(language_id.Model.fit([])).predict(["abc"])[0] == ["und"]


def test_every_language_is_learned(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(language_id.Model, "fit", lambda rows: seen.extend(rows))
    df = spark.createDataFrame([(i, f"text {i}", f"l{i % 90}") for i in range(270)], "doc_id long, text string, lang string")
    language_id.train(df)
    assert {la for _, la in seen} == {f"l{i}" for i in range(90)}


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = language_id.op2_language_id(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id")
    ok, n = got.filter("held_out").agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count(F.lit(1))).first()
    assert ok / n >= 0.98


# -- 3


def base_counts(text):
    w = re.findall(SPACES, text or "")
    windows = {}
    for i in range(len(w) - 2):
        windows.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(SPACES, x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_base_statistics(docs):
    got = quality.text_statistics(docs, ["doc_id", "text"]).select("row.*", "q").collect()
    assert len(got) == docs.count()
    for r in got:
        q = r["q"]
        want = base_counts(r["text"])
        assert (q["n_words"], q["word_chars"], q["n_symbols"], q["n_dup_lines"], q["n_repeat_words"]) == want
        assert q["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def vectors(spark, x, src=lambda i: "=s"):
    """A table of statistics as the operator writes it, with the given vectors."""
    rows = [(i, False, [float(v) for v in row], "=en", src(i)) for i, row in enumerate(x)]
    df = spark.createDataFrame(rows, "doc_id long, base_failed boolean, x array<double>, lng string, src string")
    return df.select(F.struct("doc_id").alias("row"), F.struct("base_failed", "x", "lng", "src").alias("q"))


def regular(rows, factor=1.0):
    return rows.mean(0), factor * np.cov(rows.T, bias=True) + np.diag(np.array(quality.FLOORS) ** 2)


def test_mcd_is_the_least_determinant_of_all_subsets(spark):
    rng = np.random.default_rng(5)
    for seed in range(3):
        x = np.abs(rng.normal([1.5, 2, 2, 2], [0.3, 0.8, 0.9, 0.9], (13, 4)))
        x[:3] += np.array([0, 9, 12, 9])[None] * [[1], [1.3], [0.8]]
        keep = -(-13 * 3 // 4)  # the rows before which fewer than the share of all stand
        want = min((regular(x[list(c)], quality.CONSISTENCY) for c in itertools.combinations(range(13), keep)), key=lambda e: np.linalg.det(e[1]))
        got = quality.fit(vectors(spark, x)).filter("g.level = 2").first()
        assert got["n_group"] == 13 and np.allclose(got["m"], want[0], atol=1e-9)
        assert np.allclose(got["s"], [want[1][i, j] for i, j in quality.PAIRS]) and np.isclose(got["det"], np.log(np.linalg.det(want[1])))


def test_mcd_ends_where_steps_change_nothing(spark):
    rng = np.random.default_rng(3)
    x = np.abs(rng.normal([1.5, 0.3, 0.2, 0.8], [0.2, 0.1, 0.1, 0.3], (600, 4)))
    x[:40] += [0, 3, 0, 0]
    params = quality.fit(vectors(spark, x, lambda i: f"={i % 2}"))
    for r in params.collect():
        own = x if r["g"]["level"] < 2 else x[int(r["g"]["src"][1:]) :: 2]
        s = np.zeros((4, 4))
        for (i, j), v in zip(quality.PAIRS, r["s"]):
            s[i, j] = s[j, i] = v
        bins = np.floor(np.log1p(np.einsum("ij,jk,ik->i", own - r["m"], np.linalg.inv(s), own - r["m"])) * quality.BINS)
        near = own[np.array([(bins < b).sum() for b in bins]) < quality.SHARE * len(own)]
        m, want = regular(near, quality.CONSISTENCY)
        assert np.isclose(np.linalg.slogdet(want)[1], r["det"], atol=1e-4) and r["n_group"] == len(own)
    rows = {r["row"]["doc_id"]: r for r in quality.judge(vectors(spark, x, lambda i: f"={i % 2}"), params).collect()}
    by = {r["g"]: (np.array(r["m"]), np.array(r["s"]), r["n_group"]) for r in params.collect()}
    draw = lambda e, to: [(e[2] * e[k] + quality.PRIOR * to[k]) / (e[2] + quality.PRIOR) for k in (0, 1)]
    whole, lang = (by[next(g for g in by if g["level"] == k)] for k in (0, 1))
    lang = draw(lang, whole)
    for src in (0, 1):
        m, flat = draw(by[next(g for g in by if g["src"] == f"={src}")], lang)
        s = np.zeros((4, 4))
        for (i, j), v in zip(quality.PAIRS, flat):
            s[i, j] = s[j, i] = v
        for i in range(src, 600, 2):
            d = (x[i] - m) @ np.linalg.inv(s) @ (x[i] - m)
            assert np.isclose(rows[i]["d2"], d) and rows[i]["kept"] == (d <= quality.CUTOFF)
    assert not any(rows[i]["kept"] for i in range(40)) and all(rows[i]["kept"] for i in range(40, 600))
    few = quality.judge(vectors(spark, x, lambda i: f"={i % 2}"), params, broadcast_rows=0)
    assert {r["row"]["doc_id"]: r["kept"] for r in few.collect()} == {i: r["kept"] for i, r in rows.items()}


def test_quality_keeps_clean_rows_and_columns(docs):
    out = quality.keep_documents(docs)
    assert out.columns == docs.columns
    kept = {r["doc_id"] for r in out.collect()}
    assert not kept & {r["doc_id"] for r in docs.collect() if base_counts(r["text"])[0] < 50}
    assert quality.keep_documents(empty(docs)).count() == 0


def test_each_statistic_rejects_alone(spark):
    r = random.Random(14)
    lines = lambda w: "\n".join(" ".join(w[i : i + 10]) for i in range(0, len(w), 10))
    clean = [lines(prose(r, 120).split()) for _ in range(240)]
    passage = prose(r, 48).split()
    odd = {
        "length": lines([w + "ab" for w in prose(r, 120).split()]),
        "symbols": lines([w + "#" * (i % 7 == 0) for i, w in enumerate(prose(r, 120).split())]),
        "lines": "\n".join(r.choice(VOCAB[:40]) for _ in range(400)),
        "repeats": lines(passage + prose(r, 57).split() + passage + prose(r, 47).split()),
    }
    data = [(str(i), t, "en", "s") for i, t in enumerate(clean)] + [(k, t, "en", "s") for k, t in odd.items()]
    got = {x["row"]["doc_id"]: x for x in quality.verdicts(spark.createDataFrame(data, "doc_id string, text string, lang string, source string"), ["doc_id"]).collect()}
    assert not any(got[k]["q"]["base_failed"] or got[k]["kept"] for k in odd)
    assert sum(got[str(i)]["kept"] for i in range(240)) >= 238


# -- 4


def tokens(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def grams(w, n):
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def test_containment_by_brute_force(spark):
    r = random.Random(6)
    items = [(i, prose(r, n)) for i, n in enumerate((1, 3, 5, 6, 20, 45, 60))] + [(90, None), (91, " .,! "), (92, "Same, item"), (93, "same item")]
    long = {i: t.split() for i, t in items if t}
    data = [(0, None), (1, ""), (2, "nothing here")]
    for i, w in long.items():
        for cut in (0, 1, 2, 5, 9, 15):
            body = list(w)
            for _ in range(min(cut, len(body))):
                body[r.randrange(len(body))] = "zzz"
            data.append((len(data), prose(r, 700) + "\n" + " ".join(body).upper() + " " + prose(r, 30)))
    data += [data[5], data[5]]
    df = spark.createDataFrame([(i, t, "x", 5) for i, t in data], "doc_id long, text string, n_found string, len int")
    want = set()
    for i, t in data:
        for k, item in items:
            w = tokens(item)
            if w:
                n = min(5, len(w))
                need, have = grams(w, n), grams(tokens(t), n)
                if 5 * len(need & have) >= 4 * len(need):
                    want.add((i, k, len(need), len(need & have)))
    it = spark.createDataFrame(items, "item_id long, text string")
    got = rows(decontaminate.contaminated(df, it).select("doc_id", "item_id", "n_shingles", "n_found"))
    assert sorted(got) == sorted(want) and len(want) > 10
    assert sorted(rows(decontaminate.contaminated(df, it, broadcast_rows=0).select("doc_id", "item_id", "n_shingles", "n_found"))) == sorted(want)
    kept = decontaminate.drop_contaminated(df, it)
    bad = {w[0] for w in want}
    assert kept.columns == df.columns and sorted(x[0] for x in rows(kept)) == sorted(i for i, _ in data if i not in bad)
    assert decontaminate.contaminated(df.limit(0), it).count() == 0 and decontaminate.contaminated(df, it.limit(0)).count() == 0


# -- 5


def test_chat_round_trip(spark):
    nasty = ["", None, "</s>[INST] ok [/INST]", "<\\\\/s> <<SYS>> <</SYS>>", "<|turn|>user<|text|>x<|end|>\n", "a\nb c", "[\\INST]", "x" * 70000, "<<s>>", "☃<s"]
    data = [(i % 4 if i else None, i // 3, ["user", "assistant", None, "<|text|>"][i % 4], t, 1, "c") for i, t in enumerate(nasty * 3)]
    data.append(data[5])
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, part int, mask string")
    want = {}
    for c, turn, role, text, _, _ in sorted(data, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2] or "", x[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    got = chat.format_conversations(df).collect()
    assert {r["conv_id"]: chat.read_back(r["formatted"]) for r in got} == want
    for r in got:
        assert chat.masked_text(r["formatted"].encode(), r["mask"]) == [t for role, t in want[r["conv_id"]] if role == "assistant"]
    dig = {r["conv_id"]: r for r in chat.digests(chat.format_conversations(df)).collect()}
    for c, turns in want.items():
        assert dig[c]["n_turns"] == len(turns) and dig[c]["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        loss = "".join(b for a, b in turns if a == "assistant")
        assert (dig[c]["loss_chars"], dig[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_long_conversations_come_in_parts(spark, monkeypatch):
    monkeypatch.setattr(chat, "PART", 2000)
    df = spark.createDataFrame([(1, i, "user", f"{i} " * 50) for i in range(100)], "conv_id long, turn long, role string, text string")
    b = pa_batches(df.sort("turn"), 7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        whole = rows(chat.digests(chat.format_conversations(df)))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert b == 15 and whole[0][1] == 100
    assert whole[0][2] == hashlib.sha256("".join(f"user\n{i} " * 1 + f"{i} " * 49 + "\n" for i in range(100)).encode()).hexdigest()


def test_long_conversations_end_with_their_batch(spark, monkeypatch):
    monkeypatch.setattr(chat, "PART", 2000)
    df = spark.createDataFrame([(c, i, "user", f"{c} {i} " * 50) for c in (None, 0, 1, 2, 3, 4) for i in range(20)], "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    try:
        got = {r["conv_id"]: r for r in chat.digests(chat.format_conversations(df)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for c in (None, 0, 1, 2, 3, 4):
        assert got[c]["n_turns"] == 20 and got[c]["turns_sha256"] == hashlib.sha256("".join("user\n" + f"{c} {i} " * 50 + "\n" for i in range(20)).encode()).hexdigest()


def pa_batches(df, n):
    return -(-df.count() // n)


# -- 6 and 9


@pytest.fixture(scope="module")
def tk():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pt.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def test_bpe_equals_the_library(docs, tk):
    got = bpe.encode_documents(docs, PATH, pt.PATTERN, ["doc_id", "text", "keys", "n_tokens"], ids_out=True).collect()
    assert len(got) == docs.count() and all(r["_n_tokens"] == "kept" for r in got)
    for r in got:
        text = r["text"] or ""
        ids = tk.encode_ordinary(text)
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and tk.decode(ids) == text and r["keys"] == "kept"
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode_documents(empty(docs), PATH, pt.PATTERN, ["doc_id"]).count() == 0


def test_bpe_on_random_strings(tk):
    r = random.Random(8)
    c = bpe.Codec(PATH, pt.PATTERN)
    parts = ["a", "b ", " ", "\n", "  ", "\t", "é", "x'll", "12", "!?", " ", "日本", "ß", "😀", " \n", "the", " the"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(400)] + ["zq" * 900, "abc" * 150]
    states = c.encode(texts)
    for t, state in zip(texts, states):
        assert bpe.tokens(state).tolist() == tk.encode_ordinary(t)
    assert c.decode([bpe.tokens(x) for x in states]) == [t.encode() for t in texts]
    small = bpe.Generations(3)
    for k in range(10):
        small.add({k: k})
    assert len(small.new) + len(small.old) <= 6


def by_single_pairs(word, ranks):
    """The leftmost pair of least rank, again and again."""
    parts = [bytes([c]) for c in word]
    while pairs := [(ranks[x + y], i) for i, (x, y) in enumerate(zip(parts, parts[1:])) if x + y in ranks]:
        i = min(pairs)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[x] for x in parts]


def test_words_of_any_length_contract_pair_by_pair(tk):
    ranks = bpe.read_ranks(PATH)
    r = random.Random(3)
    c = bpe.Codec(PATH, pt.PATTERN)
    words = ["".join(r.choice(abc) for _ in range(n)).encode() for n in (2, 5, 9, 14, 30, 200, 700) for abc in ("a", "ab", "aab", "abstion", "eE", "xyz0-") for _ in range(12)]
    for w, state in zip(words, c.states_of(words)):
        assert bpe.tokens(state).tolist() == ([ranks[w]] if w in ranks else by_single_pairs(w, ranks))
    long = ["zq" * 50_000, "a" * 100_001, "".join(r.choice("ACGT") for _ in range(100_000))]
    assert [bpe.tokens(x).tolist() for x in c.encode(long)] == [tk.encode_ordinary(x) for x in long]


def test_pairs_whose_order_matters_contract_one_at_a_time():
    r = random.Random(5)
    for _ in range(30):  # invented vocabularies, in which ranks follow no order of growth
        made = {bytes([c]): c for c in range(256)}
        more = list({bytes(r.choice(b"ab") for _ in range(r.randint(2, 5))) for _ in range(14)})
        r.shuffle(more)
        made.update({b: 256 + i for i, b in enumerate(more)})
        lines = "".join(base64.b64encode(b).decode() + f" {i}\n" for b, i in made.items())
        import tempfile

        with tempfile.NamedTemporaryFile("w") as f:
            f.write(lines)
            f.flush()
            c = bpe.Codec(f.name, pt.PATTERN)
        words = [bytes(r.choice(b"ab") for _ in range(r.randint(6, 40))) for _ in range(40)]
        for w, state in zip(words, c.states_of(words)):
            assert bpe.tokens(state).tolist() == by_single_pairs(w, made)


def test_token_counts_by_brute_force(docs):
    import regex

    scores = token_counts.unigram_scores(bpe.read_ranks(PATH))

    def best(w):
        b = [(0, 0)]
        for i in range(1, len(w) + 1):
            b.append(max((b[j][0] + scores[w[j:i]], b[j][1] - 1) for j in range(max(0, i - 130), i) if w[j:i] in scores))
        return -b[-1][1]

    small = docs.filter("length(text) < 2000 OR text IS NULL")
    got = token_counts.count_tokens(small, PATH, pt.PATTERN).collect()
    texts = {}
    for r in small.collect():
        texts.setdefault(r["doc_id"], r["text"] or "")
    assert len(got) == small.count()
    for r in got:
        words = regex.findall(pt.PATTERN, texts[r["doc_id"]])
        assert (r["n_pretokens"], r["n_tokens"]) == (len(words), sum(best(w.encode()) for w in words))


# -- 7


def test_tree_marginals_equal_enumeration():
    page = "<div class=nav><p>a b</p></div><article><p>some, text.</p><ul><li>x</li></ul></article>"
    f = html_extract.Forest([html_extract.Dom(page), html_extract.Dom("")])
    rng = np.random.default_rng(2)
    w, pair = rng.normal(size=html_extract.FEATURES), rng.normal(size=(2, 2))
    p, both = f.marginals(w, pair)
    unary = np.bincount(f.owner, w[f.feats], f.n)
    want, total, joint = np.zeros(f.n), 0.0, np.zeros((2, 2))
    for s in np.ndindex(*[2] * f.n):
        weight = np.exp(sum(unary[i] * s[i] for i in range(f.n)) + sum(pair[s[f.parent[i]], s[i]] for i in range(f.n) if f.parent[i] >= 0 and i not in f.first[:-1]))
        total += weight
        want += weight * np.array(s)
        for i in range(f.n):
            if i not in f.first[:-1]:
                joint[s[f.parent[i]], s[i]] += weight
    assert np.allclose(p, want / total) and np.allclose(both, joint / total)


def test_extraction(spark):
    model = html_extract.train(labelled_pages(300))
    held = labelled_pages(150, seed=77)
    got = html_extract.texts(held, model)
    want = [[b for _, b in html_extract.Dom(h).blocks if MARK in b] for h in held]
    found = [t.split("\n\n") if t else [] for t in got]
    total = sum(map(len, want))
    assert sum(len(set(w) - set(f)) for w, f in zip(want, found)) <= 0.04 * total
    assert sum(len(set(f) - set(w)) for w, f in zip(want, found)) <= 0.04 * total
    page = "<html><head><title>no</title></head><body><nav><a href=x>Menu</a></nav><article><h1>A &amp; B</h1><p>One<br>two\n three&nbsp;x<script>var a='<p>';</script></p><p>Four &lt;5&gt;<p>Six</article><footer>&copy; me</footer></body>"
    df = spark.createDataFrame([(1, "u", page, "t"), (1, "u", page, "t"), (2, None, None, None), (None, "v", "", "x"), (4, "w", "<" * 5000 + "<p" * 3000, "x"), (5, "w", "<div>" * 3000, "x")], "page_id long, url string, html string, text string")
    out = html_extract.extract(df, model).collect()
    assert [r["text"] for r in out if r["page_id"] == 1] == ["A & B\n\nOne two three x\n\nFour <5>\n\nSix"] * 2
    assert all(r["text"] == "" and r["n_chars"] == 0 for r in out if r["page_id"] in (2, None)) and len(out) == 6
    assert html_extract.extract(df.limit(0), model).count() == 0


def test_missing_ends_of_head_and_others():
    texts = lambda page: [b for _, b in html_extract.Dom(page).blocks]
    assert texts("<head><title>no</title><body><article><p>before</p><header><h1>Title</h1></header><p>after</p></article>") == ["before", "Title", "after"]
    assert texts("<head><title>no</title></head ><body><p>a</p></body>") == ["a"]
    for t in ("svg", "math", "canvas", "object", "select"):
        assert texts(f"<p>a</p><{t}><p>b</p>") == ["a", "b"] and texts(f"<p>a</p><{t}>x</{t}><p>b</p>") == ["a", "b"]


def test_raw_elements_nest_and_offsets_stand():
    texts = lambda page: [b for _, b in html_extract.Dom(page).blocks]
    for t in ("svg", "object", "template"):
        assert texts(f"<p>a</p><{t}>x<{t.upper()} id=y>y</{t}>z</{t}><p>b</p>") == ["a", "b"]
        assert texts(f"<p>a</p><{t}>x<{t}>y</{t}><p>b</p>")[0] == "a"
    assert texts("<p>" + "\u0130" * 90 + "</p><SCRIPT>var a;</Script><p>Second paragraph of text</p>") == ["\u0130" * 90, "Second paragraph of text"]
    assert texts("<p>a</p><script>x</\u017fcript>y</script><p>b</p>") == ["a", "b"]


# -- 8


def shingles(text):
    w = re.findall(SPACES, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w)} if 0 < len(w) < 3 else {tuple(w[i : i + 3]) for i in range(len(w) - 2)}


def clusters(data):
    sets = [(i, shingles(t)) for i, t in data]
    parent = {i: i for i, _ in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 90 * len(x | y):
                p, q = root(sets[a][0]), root(sets[b][0])
                parent[max(p, q)] = min(p, q)
    return {i: (len(s), root(i)) for i, s in sets}


def test_jaccard_join_by_brute_force(spark, docs, monkeypatch):
    r = random.Random(9)
    base = prose(r, 300).split()
    data = [(x["doc_id"], x["text"]) for x in docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).collect()]
    for k in range(70):  # a crowd around the threshold
        w = list(base)
        for _ in range(r.randint(0, 14)):
            w[r.randrange(len(w))] = r.choice(VOCAB)
        data.append((100 + k, " ".join(w)))
    data += [(300 + k, prose(r, 20) + " shared passage of some length in very many documents " + prose(r, 20)) for k in range(60)]
    df = spark.createDataFrame([(i, t, 7) for i, t in data], "doc_id long, text string, n int")
    want = clusters(data)
    for deal, outside, block in ((2048, 256, 2048), (5, 2, 3)):
        monkeypatch.setattr(ngram_join, "DEAL", deal)
        monkeypatch.setattr(ngram_join, "OUTSIDE", outside)
        monkeypatch.setattr(ngram_join, "BLOCK", block)
        got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in ngram_join.cluster(df).collect()}
        assert got == want
    assert ngram_join.cluster(docs).count() == docs.count()
    kept = ngram_join.one_of_each(df)
    assert kept.columns == df.columns and sorted(x[0] for x in rows(kept)) == sorted(i for i in want if want[i][1] == i)
    assert ngram_join.cluster(df.limit(0)).count() == 0


def clusters_by(data, words, percent):
    def cut(text):
        w = re.findall(SPACES, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(w)} if 0 < len(w) < words else grams(w, words)

    sets = {i: cut(t) for i, t in data}
    least = {i: i for i in sets}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    return {i: (len(s), least[i]) for i, s in sets.items()}


def test_pipeline_stage_takes_five_words_and_four_fifths(spark, monkeypatch):
    import corpus_pipeline

    r = random.Random(12)
    body, base = prose(r, 100), prose(r, 300).split()
    data = [(0, body), (1, body + " " + prose(r, 12)), (2, None), (3, ""), (4, "one two"), (5, "One  two"), (6, "a b c d"), (7, "a b c d e")]
    for k in range(60):  # a crowd around the threshold
        w = list(base)
        for _ in range(r.randint(0, 14)):
            w[r.randrange(len(w))] = r.choice(VOCAB)
        data.append((100 + k, " ".join(w)))
    df = spark.createDataFrame([(i, t, 7) for i, t in data], "doc_id long, text string, n int")
    three, want = clusters(data), clusters_by(data, 5, 80)
    assert three == clusters_by(data, 3, 90) and three[1][1] == 1 and want[1][1] == 0
    for outside, block in ((256, 2048), (2, 3)):
        monkeypatch.setattr(ngram_join, "OUTSIDE", outside)
        monkeypatch.setattr(ngram_join, "BLOCK", block)
        assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in ngram_join.cluster(df, 5, 80).collect()} == want
    assert sorted(x[0] for x in rows(corpus_pipeline.near_duplicate_stage(spark, df, ""))) == sorted(i for i in want if want[i][1] == i)


def test_bitmaps_bound_overlaps():
    rng = np.random.default_rng(4)
    for n, m in ((5, 9), (80, 70), (400, 900)):
        pool = rng.integers(0, 2**63, 1200).astype(np.uint64)
        a, b = (np.sort(rng.choice(pool, k, replace=False)) for k in (n, m))
        assert ngram_join.overlap_bound(ngram_join.bitmap(a), ngram_join.bitmap(b), n, m) >= len(np.intersect1d(a, b))


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(r.randrange(100, 160), r.randrange(100, 160)) for _ in range(45)] + [(200, 200)]
    got = dict(rows(components(spark.createDataFrame(edges, "a long, b long"))))
    parent = {}

    def root(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        p, q = root(a), root(b)
        parent[max(p, q)] = min(p, q)
    assert got == {i: root(i) for i in parent if i != 200 and any(i in e and e[0] != e[1] for e in edges)}


# -- 10


def dedup(data):
    def key(line):
        k = line.strip(" \t\n\x0b\x0c\r")
        k = re.sub("[A-Z]", lambda m: m[0].lower(), k)
        return k if len(k) >= 20 else None

    holders = {}
    for i, t in data:
        for x in (t or "").split("\n"):
            if (k := key(x)) is not None:
                holders.setdefault(k, set()).add(i)
    out = []
    for i, t in data:
        lines = (t or "").split("\n")
        kept = [x for x in lines if (k := key(x)) is None or len(holders[k]) < 3 or i == max((d for d in holders[k] if d is not None), default=None)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_line_dedup_by_brute_force(docs):
    data = [(r["doc_id"], r["text"]) for r in docs.collect()]
    index = line_dedup.LineIndex.build(docs, shard_keys=7)
    got = line_dedup.rewrite(docs, index).select("row.doc_id", "n_lines", "n_dropped", "text")
    order = lambda rs: sorted(rs, key=lambda r: (r[0] is not None, r[0] or 0, r[3]))
    assert order(rows(got)) == order(dedup(data)) and any(r[2] for r in dedup(data))
    out = line_dedup.dedup_documents(docs)
    assert out.columns == docs.columns and all(r["n_chars"] == len(r["text"]) and r["row"] == "kept" for r in out.collect())
    assert line_dedup.dedup_documents(empty(docs)).count() == 0


def test_line_index_is_reversible(docs):
    old, new = docs.filter("doc_id < 19"), docs.filter("doc_id >= 19")
    plain = line_dedup.LineIndex.build(old, shard_keys=3)
    whole = plain.insert(new)
    both = docs.filter("doc_id IS NOT NULL")
    table = lambda ix: sorted((r["k1"], r["k2"], r["n_docs"], r["last_doc"]) for r in ix.counts.collect())
    assert table(whole) == table(line_dedup.LineIndex.build(both, shard_keys=3))
    back = whole.delete(new.select("doc_id"))
    assert table(back) == table(plain)
    assert sorted(map(str, rows(back.drops()))) == sorted(map(str, rows(plain.drops())))
    want = {i: n for i, _, n, _ in dedup([(r["doc_id"], r["text"]) for r in both.collect()])}
    got = line_dedup.rewrite(both, whole).collect()
    assert all(r["n_dropped"] == want[r["row"]["doc_id"]] for r in got)


def test_cuckoo_filter():
    rng = np.random.default_rng(5)
    keys = np.unique(rng.integers(0, 2**63, 5000).astype(np.uint64))
    f = line_dedup.CuckooFilter.of(keys)
    assert f.contains(keys).all()
    other = rng.integers(0, 2**63, 20000).astype(np.uint64)
    assert f.contains(other).mean() < 0.01
    f = line_dedup.CuckooFilter.from_bytes(f.to_bytes())
    f.delete(keys[:2500])
    assert f.contains(keys[2500:]).all() and f.contains(keys[:2500]).mean() < 0.01
    assert not line_dedup.CuckooFilter(1).insert(keys[:100])


# -- pipeline


def test_pipeline(spark):
    import corpus_pipeline as p

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns, name
        docs = line_dedup.materialize(out, "test")
    left = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len({frozenset(shingles(t)) for t in left.values() if shingles(t)}) == sum(bool(shingles(t)) for t in left.values())
    final = p.run(spark, d)
    assert {r["doc_id"]: r["decoded_sha256"] for r in final.collect()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in left.items()}


def test_ranks_are_read_as_given():
    with open(PATH, "rb") as f:
        first = f.readline().split()
    assert bpe.read_ranks(PATH)[base64.b64decode(first[0])] == int(first[1])
