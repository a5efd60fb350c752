"""Operators that learn: slopes, held-out accuracy, defined results."""

import math
import pickle
import re
import zlib
from collections import Counter

import numpy as np
from llm_data import ROWS
from pyspark.sql import functions as F

from sheafline.llm import byte_rnn, chat_hmm, pairwise_quality, suffix_tree_lm, toxicity_grammar
from sheafline.llm import textblocks as tb

MIDDLE = "/root/testdata/sf0.01"


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def test_network_slopes(monkeypatch):
    monkeypatch.setattr(byte_rnn, "_f", np.float64)
    r = np.random.default_rng(0)
    net = byte_rnn.Network(*[v.astype(float) for v in vars(byte_rnn._start(3, 4, r)).values()])
    codes, label = r.integers(0, 6, (7, 5)), r.integers(0, 3, 5)
    valid = np.arange(7)[:, None] < np.array([7, 5, 3, 7, 1])[None, :]
    _, slopes = byte_rnn._loss_and_slopes(net, codes, label, valid)
    for k, value in enumerate(vars(net).values()):
        for _ in range(4):
            at = tuple(int(r.integers(0, min(d, 6))) for d in value.shape)
            value[at] += 1e-6
            up, _ = byte_rnn._loss_and_slopes(net, codes, label, valid)
            value[at] -= 2e-6
            down, _ = byte_rnn._loss_and_slopes(net, codes, label, valid)
            value[at] += 1e-6
            assert abs((up - down) / 2e-6 - slopes[k][at]) < 1e-4


def test_languages(spark, odd, none):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    out = byte_rnn.identified_documents(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r["held_out"]]
    assert all(r["held_out"] == (fold(r["doc_id"], 3) == 1) and 0 <= r["score"] <= 1 for r in out)
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)
    labels, net = byte_rnn.fit(docs, F.lit(True), per_language=5, windows=2)
    edges = {(r["doc_id"]): r for r in byte_rnn.identify(odd, labels, net).collect()}
    assert all(edges[k]["lang_pred"] == "und" and edges[k]["score"] == 0 for k in (3, 4, 7))
    assert edges[9]["lang_pred"] in labels
    assert {r["lang_pred"] for r in byte_rnn.identified_documents(none).collect()} == set()
    assert {r["lang_pred"] for r in byte_rnn.identify(odd, [], None).collect()} == {"und"}


def test_quality(spark, odd, none):
    docs, labels = (spark.read.parquet(f"{MIDDLE}/{t}.parquet") for t in ("documents", "labels"))
    out = pairwise_quality.scored_documents(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in out) >= 0.95 * len(out)
    ranking = pairwise_quality.fit(docs, labels, F.lit(True), per_label=50)
    assert pairwise_quality.score(odd, ranking).count() == len(ROWS)
    assert all(0 <= r["_score"] <= 1 for r in pairwise_quality.score(odd, ranking).collect())
    nothing = pairwise_quality.scored_documents(odd, labels.limit(0)).collect()
    assert {r["score"] for r in nothing} == {0.5} and len(nothing) == len(ROWS)
    assert pairwise_quality.scored_documents(none, labels).count() == 0
    assert pairwise_quality.keep_good(docs, labels).columns == docs.columns


def test_toxicity(spark, odd, none):
    docs, labels = (spark.read.parquet(f"{MIDDLE}/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity_grammar.scored_documents(docs, labels).join(labels, "doc_id").collect()
    clean = [r for r in out if r["toxic"] == 0]
    assert sum(r["predicted"] for r in clean) <= 0.02 * len(clean)
    seen = [r for r in out if r["toxic"] == 1]
    assert sum(r["predicted"] for r in seen) >= 0.6 * len(seen)
    assert toxicity_grammar.scored_documents(odd, labels.limit(0)).count() == len(ROWS)
    assert toxicity_grammar.scored_documents(none, labels).count() == 0


def test_toxicity_grammar_reads_clauses():
    reader = toxicity_grammar.Reader(toxicity_grammar.Lexicon({"idiot": 1.0}, {"lowei": 1.0}))
    weight = lambda t: reader.weight(t)[0]
    assert weight("you idiot") > weight("an idiot") > weight("not an idiot") > 0
    assert weight("he said an idiot") < weight("an idiot")
    assert weight("loweiung") == 1 and weight("xlowei") == 0 and weight("idiots") == 0
    assert weight("not. An idiot") == weight("an idiot")
    assert weight("I will kill you") < weight("you will kill")
    assert reader.weight("idiot, idiot. idiot")[1] == 2
    assert weight("") == 0 and math.isclose(weight("idiot " + "x" * 100_000 + " idiot"), 2, abs_tol=0.3)


def test_suffix_tree_base_and_gain(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    out = {r["doc_id"]: r for r in suffix_tree_lm.scored_documents(docs).collect()}
    tokens = {r["doc_id"]: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or "")), "\n"] for r in docs.collect()}
    counts = Counter()
    for i, own in tokens.items():
        if fold(i, 7) != 2:
            counts.update(own)
    n, v = sum(counts.values()), len(counts)
    for i, own in tokens.items():
        r = out[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(counts[t] > 0 for t in own), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in own), rel_tol=1e-6)
    held = [r for r in out.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_suffix_tree_is_a_distribution_and_edges(odd, none):
    model = suffix_tree_lm.fit(odd, least=3, pair_least=1, word_least=3)
    shard, n = next(suffix_tree_lm._shards(model)), len(model.root)
    for context in ([0], [0, suffix_tree_lm.CLASSES], [suffix_tree_lm.CLASSES, suffix_tree_lm.CLASSES]):
        rows = np.array([[*context, s] for s in range(n)]).ravel()
        logs = shard.log_probabilities(model.root, rows, np.full(n, len(context) + 1)).reshape(n, -1)[:, -1]
        seen = np.flatnonzero(model.root > model.root.min())
        assert (10 ** logs[seen]).sum() <= 1 + 1e-6
    got = suffix_tree_lm.score(odd, model).collect()
    assert len(got) == len(ROWS) and all(math.isfinite(r["score"]) and r["score"] <= 0 for r in got)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (3, 4, 7)} == {1}
    empty = suffix_tree_lm.score(odd, suffix_tree_lm.fit(none)).collect()
    assert {r["n_known"] for r in empty} == {0} and {r["train_tokens"] for r in empty} == {0}
    assert suffix_tree_lm.scored_documents(none).count() == 0


def _plain_tree(texts, depth, least, pair_least, word_least, prior):
    """The same model as dictionaries: a function that gives the log10 probability of a text."""
    def split(text):
        return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    words = Counter(w for t in texts for w in split(t))
    tail = lambda w: ("class", w.encode()[-2:])
    symbol = lambda w: w if words[w] >= word_least else tail(w)
    of_class, kinds = Counter(), Counter()
    for w, n in words.items():
        if n < word_least:
            of_class[tail(w)] += n
            kinds[tail(w)] += 1
    sequences = [[*(symbol(w) for w in split(t)), "end"] for t in texts]
    root = Counter(s for q in sequences for s in q)
    size = sum(root.values()) + len(root) + 1
    after = {}
    for q in sequences:
        for i, s in enumerate(q):
            for d in range(1, depth + 1):
                if i >= d - 1:
                    context = tuple(q[i - k] if i >= k else "end" for k in range(1, d + 1))  # the most recent first
                    after.setdefault(context, Counter())[s] += 1
    pairs = {c[::-1] + (s,): n for c, f in after.items() if len(c) == 1 for s, n in f.items()}
    usable = lambda c: all(pairs.get((c[k + 1], c[k]), 0) >= least for k in range(len(c) - 1))
    kept, own = {}, {(): {s: (n + 1) / size for s, n in root.items()}}
    for c in sorted(after, key=len):
        total = sum(after[c].values())
        if total < least or not usable(c):
            continue
        held = {s: n for s, n in after[c].items() if n >= pair_least}
        above = own[c[:-1]]
        dropped = total - sum(held.values())
        gain = sum(n * math.log(n / total / above[s]) for s, n in held.items())
        if dropped:
            gain += dropped * (math.log(dropped / total) - math.log(max(1 - sum(above[s] for s in held), 1e-9)))
        freedom = max(len(held) - (not dropped), 1)
        share = (prior + dropped) / (total + prior)
        if held and 2 * gain > freedom + 3 * math.sqrt(2 * freedom) and 2 * gain > 1e-2 * total:
            own[c] = {s: n / (total + prior) + share * above[s] for s, n in held.items()}
            kept[c] = (share, own[c])
        else:
            own[c] = {s: above[s] for s in held}

    def log(text):
        given = split(text)
        q = [*(symbol(w) for w in given), "end"]
        out = 0.0
        for i, s in enumerate(q):
            p = (root[s] + 1) / size
            for d in range(1, min(i + 1, depth) + 1):
                c = tuple(q[i - k] if i >= k else "end" for k in range(1, d + 1))
                if c in kept:
                    p = kept[c][1].get(s, kept[c][0] * p)
            out += math.log10(p)
            if isinstance(s, tuple):
                out += math.log10((words[given[i]] + 1) / (of_class[s] + kinds[s] + 1)) if of_class[s] else 0.0
        return out

    return log, kept


def test_suffix_tree_against_a_plain_one(spark, monkeypatch):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    train = [t for i, t in rows if fold(i, 7) != 2]
    settings = {"depth": 4, "least": 8, "pair_least": 2, "word_least": 10, "prior": 20.0}
    log, kept = _plain_tree(train, **settings)
    assert max(map(len, kept)) >= 3
    for held, shard_bytes in ((1 << 19, 64 << 20), (500, 20_000)):  # one shard, and many with blocks sent early
        monkeypatch.setattr(suffix_tree_lm, "HELD", held)
        monkeypatch.setattr(suffix_tree_lm, "SHARD_BYTES", shard_bytes)
        model = suffix_tree_lm.fit(docs.filter("crc32(cast(doc_id as string)) % 7 <> 2"), **settings)
        for r in suffix_tree_lm.score(docs, model).collect():
            assert math.isclose(r["score"], log(dict(rows)[r["doc_id"]]), rel_tol=1e-5, abs_tol=1e-4), r["doc_id"]


def test_suffix_tree_keeps_one_worker_a_task(spark, monkeypatch):
    """Keys made by Python in the tasks that make the filter by Python would hold two workers a task."""
    plans = []

    def watched(keys, n):
        plans.append(keys._jdf.queryExecution().executedPlan().toString())
        return bit_filter(keys, n)

    bit_filter = suffix_tree_lm.bit_filter
    monkeypatch.setattr(suffix_tree_lm, "bit_filter", watched)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    suffix_tree_lm.fit(docs, least=8)
    assert len(plans) == 1 and "Python" not in plans[0]


def test_powers_follow_the_slices(monkeypatch):
    whole = [x.copy() for x in tb.powers(5000)]
    monkeypatch.setattr(tb, "_powers", [np.ones(1, np.uint64), np.ones(1, np.uint64)])
    for n in (1, 1000, 1001, 5000):
        assert all((x == y[:n]).all() for x, y in zip(tb.powers(n), whole))
        assert len(tb._powers[0]) <= 2 * n


def test_suffix_tree_grows_with_its_corpus(spark):
    sizes = []
    for sf in ("sf0.001", "sf0.01"):
        docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
        sizes.append(suffix_tree_lm.fit(docs).tree.count())
    assert sizes[1] > 3 * sizes[0]


def _plain_viterbi(tables, obs):
    score, backs = tables.start + tables.emit[:, obs[0]], []
    for o in obs[1:]:
        ways = score[:, None] + (tables.move + tables.emit[:, o][None, :])
        backs.append(ways.argmax(axis=0))
        score = ways.max(axis=0)
    path = [int(score.argmax())]
    for back in reversed(backs):
        path.append(int(back[path[-1]]))
    return [chat_hmm.STATES[k] for k in reversed(path)]


def _talks(spark):
    talks = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    long = [(10_000, t, ("user", "assistant")[t % 2], None if t % 7 == 3 else f"text {t}\nmore?" * (1 + t % 4)) for t in range(60)]
    odd = [(None, 0, "user", "no id"), (None, 1, "assistant", ""), (10_001, None, "user", "no turn"), (10_002, 1, None, "who"), (10_002, 1, "tool", "what")]
    return talks.unionByName(spark.createDataFrame(long + odd, "conv_id bigint, turn int, role string, text string").select(*[F.col(c).cast(t) for c, t in talks.dtypes]))


def test_chat_viterbi_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(chat_hmm, "CHUNK", 3)
    monkeypatch.setattr(chat_hmm, "CALL_ROWS", 40)
    monkeypatch.setattr(chat_hmm, "PART_LINES", 4)
    talks = _talks(spark)
    lines = chat_hmm.transcript(talks, F.pmod(F.xxhash64("conv_id", "turn"), F.lit(10)) < 6)
    tables = chat_hmm.fit(chat_hmm.observed(chat_hmm.numbered(lines)))
    for limit in (None, 5):  # windows, and chunks of a range partitioning
        found = chat_hmm.recover(lines.select("conv_id", "n", "line", F.lit(1).alias("turn"), F.lit("x").alias("role_pred")), tables, limit).toPandas()
        assert len(found) == lines.count()
        for _, own in found.groupby("conv_key"):
            own = own.sort_values("pos")
            path = _plain_viterbi(tables, own["obs"].to_numpy())
            assert own["role_pred"].tolist() == [role for role, _ in path]
            assert own["turn"].tolist() == (np.cumsum([begins for _, begins in path]) - 1).tolist()
            assert path[0][1] and own["pos"].tolist() == list(range(1, len(own) + 1))
    whole = {}
    for r in chat_hmm.rendered(chat_hmm.recover(lines, tables)).orderBy("conv_key", "turn", "part").collect():
        assert r["n_lines"] <= 4
        whole.setdefault(r["conv_key"], []).append(r["rendered"])
    for key, own in found.groupby("conv_key"):
        own = own.sort_values("pos")
        want = "".join(f"<|{g['role_pred'].iloc[0]}|>\n" + "\n".join(g["body"]) + "\n<|end|>" for _, g in own.groupby("turn"))
        assert "".join(whole[key]) == want


def test_chat_finds_turns_that_were_held_out(spark):
    """Border precision and recall, and roles, on conversations that were not learnt from."""
    out = [r for r in chat_hmm.formatted(spark.read.parquet(f"{MIDDLE}/conversations.parquet")).collect() if r["held_out"]]
    found, right, true = len(out), sum(r["begins"] for r in out), sum(r["n_begins"] for r in out)
    assert right / found > 0.95 and right / true > 0.6
    assert sum(r["correct"] for r in out) / found > 0.9


def test_chat_edges(spark):
    talks = _talks(spark)
    out = chat_hmm.formatted(talks).collect()
    assert {r["conv_id"] for r in out} == {r["conv_id"] for r in talks.collect()}
    assert sum(r["n_lines"] for r in out) == chat_hmm.transcript(talks, F.lit(True)).count()
    odd = spark.createDataFrame([(None, None, None), (None, 1, "User: a"), (None, 1, "User: a"), ("x", 0, "")], "conv_id string, n int, line string")
    tables = chat_hmm.fit(chat_hmm.observed(chat_hmm.numbered(chat_hmm.transcript(talks, F.lit(True)))))
    got = chat_hmm.recover(odd, tables).collect()
    assert len(got) == 4 and sorted((r["conv_key"], r["pos"]) for r in got) == [("", 1), ("", 2), ("", 3), ("=x", 1)]
    assert chat_hmm.formatted(talks.limit(0)).count() == 0


def test_suffix_tree_symbols_do_not_depend_on_the_size(spark):
    """A word that occurs ``word_least`` times is a symbol, however many tokens there are besides."""
    words = spark.createDataFrame([(1, 100), (2, 99), (3, 10**12)], "key bigint, n bigint")
    held = suffix_tree_lm._frequent(words, 100)
    assert held.keys.tolist() == [1, 3] and held.counts.tolist() == [100, 10**12]


def test_suffix_tree_tables_and_orders():
    rng = np.random.default_rng(3)
    crowded = np.uint64(7 << 40) + np.arange(300, dtype=np.uint64)  # all at one place
    top = np.uint64(2**64 - 3) - np.arange(50, dtype=np.uint64)  # beyond the last place
    keys = np.unique(np.concatenate((rng.integers(0, 2**63, 5000, dtype=np.uint64) * np.uint64(2), crowded, top)))
    for own in (keys, keys[:1], keys[:0]):
        table = suffix_tree_lm.Table.of(own, np.arange(len(own), dtype=np.int32))
        asked = np.concatenate((own, keys + np.uint64(1), np.zeros(1, np.uint64)))
        held, at = table.find(asked)
        assert held.tolist() == np.isin(asked, own).tolist()
        assert (own[table.values[at[held]]] == asked[held]).all()
    odd = pow(0x9E3779B97F4A7C15, -1, 2**64)
    alike = np.array([(5 << 40) * odd % 2**64, ((5 << 40) + 1) * odd % 2**64], np.uint64)  # differ in the last bit when spread
    for some in (np.tile(alike, 40), rng.choice(keys[:200], 3000), keys[:1]):
        own = some[suffix_tree_lm.together(some)]
        assert sorted(own.tolist()) == sorted(some.tolist())
        assert (own[1:] != own[:-1]).sum() + 1 == len(np.unique(some))
        at, n = suffix_tree_lm.grouped(some)
        assert Counter(some.tolist()) == sum((Counter({k: c}) for k, c in zip(some[at].tolist(), n.tolist())), Counter())
    many = rng.integers(0, 2**63, 70_000, dtype=np.uint64)
    ctx, sym = np.concatenate((np.tile(alike, 40), many, many)), np.concatenate((np.arange(80) % 3, np.arange(140_000) % 5)).astype(np.int32)
    for wide in (0, 2**30):  # symbols that fit beside the context's number and place in 64 bits, and such that do not
        times = np.ones(len(ctx), np.int32)
        got = suffix_tree_lm._sorted_pairs([(ctx, sym + wide, times, ctx, sym, np.ones(len(ctx), np.int8))])
        found = list(zip(got[0].tolist(), got[1].tolist()))
        assert dict(zip(found, got[2].tolist())) == Counter(zip(ctx.tolist(), (sym + wide).tolist())) and len(found) == len(set(found))
        assert (got[0][1:] != got[0][:-1]).sum() + 1 == len(np.unique(ctx))


def test_suffix_tree_words_meet_their_counts_unsorted(spark):
    """Rare words are the most rows of the query: they are hashed, not sorted, and one that a text repeats is one row."""
    docs = spark.createDataFrame([(1, "aa bb aa cc aa"), (2, None), (1, "bb"), (None, "zz zz")], "doc_id long, text string")
    model = suffix_tree_lm.fit(docs.filter("doc_id is not null"))
    scores = suffix_tree_lm.score(docs, model)
    assert all(b"sheafline" not in pickle.dumps(x.plain()) for x in suffix_tree_lm._shards(model))  # broadcasts need no package
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    got = {(r["doc_id"], r["n_tokens"], r["n_known"]): r["base_score"] for r in scores.collect()}
    counts, total = {"aa": 3, "bb": 2, "cc": 1, "\n": 3}, 9
    for (i, n, known), text in (((1, 6, 6), "aa bb aa cc aa"), ((2, 1, 1), ""), ((1, 2, 2), "bb"), ((None, 3, 1), "zz zz")):
        expected = sum(math.log10((counts.get(w, 0) + 1) / (total + 4 + 1)) for w in [*text.split(), "\n"])
        assert math.isclose(got[(i, n, known)], expected, rel_tol=1e-7)
