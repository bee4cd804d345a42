"""The pipeline's stages, and run() as a whole, against plain Python on a small corpus."""

import random
import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from larkspur.llm.rules import STOP_WORDS

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def corpus():
    """Clean texts of shared words, copies, near copies, lines repeated up to two edits, junk, null and empty texts, and repeated rows."""
    rng = random.Random(5)
    pool = [f"{a}{b}" for a in "br cl dr fl gr pl st tr".split() for b in "ane eld ick one ump ay ore int".split()] + STOP_WORDS[:12]
    line = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    shared = [line(8) for _ in range(4)]
    texts = []
    for i in range(70):
        lines = [line(rng.randrange(5, 14)) for _ in range(rng.randrange(2, 5))]
        if i % 5 == 0:
            s = list(shared[i % 4])
            for _ in range(i % 3):
                s[rng.randrange(len(s))] = rng.choice("xyzé")
            lines.insert(rng.randrange(len(lines)), "".join(s))
        texts.append("\n".join(lines))
    texts += [texts[3], texts[3], texts[8] + " tail", texts[9].upper(), None, "", " \n\t", "too short", "# $ % & | < > #" + texts[1], "a b c d e " * 30, "! " * 40,
              "same words on this line of the page\n" * 9]
    rows = [(i, t, "en", None if i % 7 == 6 else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return rows + rows[2:4]


def passes(t):
    w, lines = split(t), [x for x in (t or "").split("\n") if split(x)]
    n = len(w)
    seen = Counter(tuple(w[i:i + 5]) for i in range(n - 4))
    hit = {i + k for i in range(n - 4) if seen[tuple(w[i:i + 5])] > 1 for k in range(5)}
    if n < 10 or 100 * len(hit) > 20 * n or not 2 <= sum(map(len, w)) / n <= 15 or len(re.findall(r"[#*$%&|<>]", t)) / n > 0.25:
        return False
    if (len(lines) - len(set(lines))) / len(lines) > 0.4 or t.count("!") / n > 0.5:
        return False
    return n < 30 or (sum(x.lower() in STOP_WORDS for x in w) / n >= 0.04 and n / len(lines) >= 1.5)


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def classes(items, linked):
    """The place of the first item of each item's component."""
    at = list(range(len(items)))
    for i in range(len(items)):
        for j in range(i):
            if at[i] != at[j] and linked(items[i], items[j]):
                old, new = max(at[i], at[j]), min(at[i], at[j])
                at = [new if x == old else x for x in at]
    return at


def without_lines(rows):
    """Lines of 24 characters or more by classes of two edits, shorter ones by equality, blank ones never."""
    every = {x for r in rows for x in (r[1] or "").split("\n") if split(x)}
    lines = sorted(x for x in every if len(x) >= 24)
    root = dict(zip(lines, classes(lines, lambda a, b: abs(len(a) - len(b)) <= 2 and edit(a, b) <= 2))) | {x: x for x in every if len(x) < 24}
    first = {}
    for r in rows:
        for no, x in enumerate((r[1] or "").split("\n")):
            if x in root:
                first[root[x]] = min(first.get(root[x], (r[0], no)), (r[0], no))
    out = []
    for r in rows:
        left = "\n".join(x for no, x in enumerate((r[1] or "").split("\n")) if x not in root or first[root[x]] == (r[0], no))
        if split(left):
            out.append((r[0], left, *r[2:]))
    return out


def alike(a, b):
    x, y = ({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} for w in (split((t or "").lower()) for t in (a, b)))
    return 9 * len(x & y) >= 4 * (len(x) + len(y))


def without_copies(rows):
    rows = sorted(set(rows))
    root = classes([r[1] for r in rows], alike)
    return [r for i, (r, k) in enumerate(zip(rows, root)) if i == k]


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """What each stage makes of what its predecessor made, with that."""
    at, out = tmp_path_factory.mktemp("pipeline"), {}
    docs = spark.createDataFrame(corpus(), DOCS)
    docs.write.parquet(f"{at}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(at)).write.parquet(f"{at}/{k}")
        before, docs = docs, spark.read.parquet(f"{at}/{k}")
        out[name] = [tuple(r) for r in before.collect()], docs.columns, [tuple(r) for r in docs.collect()]
    return str(at), out


def test_stages_keep_columns(steps):
    assert [columns == COLUMNS for _, columns, _ in steps[1].values()] == [True] * 4 + [False]


def test_rules_stage(steps):
    before, _, after = steps[1]["quality rules"]
    assert sorted(after) == sorted(r for r in before if passes(r[1])) and 60 < len(after) < len(before)


def test_line_stage(steps):
    before, _, after = steps[1]["line dedup"]
    assert sorted(after) == sorted(without_lines(before)) and sorted(after) != sorted(before)


def test_copies_stage(steps):
    before, _, after = steps[1]["SimHash near-dedup"]
    assert sorted(after) == without_copies(before) and len({r[0] for r in after}) == len(after)


def test_copies_stage_on_whole_texts(spark):
    rows = [r for r in corpus() if passes(r[1])]
    got = dict(corpus_pipeline.STAGES)["SimHash near-dedup"](spark, spark.createDataFrame(rows, DOCS), "")
    kept = without_copies(rows)
    assert sorted(map(tuple, got.collect())) == kept and len(kept) < len(set(rows))


def test_mixing_stage(steps):
    before, _, after = steps[1]["mixing"]
    size, taken, copies = Counter(), Counter(), Counter(after)
    for r in before:
        size[r[3]] += len(split(r[1]))
        taken[r[3]] += len(split(r[1])) * copies[r]
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight, over = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, set()
    while True:
        level = (sum(size.values()) - sum(3 * size[s] for s in over)) / sum(weight[s] for s in order if s not in over)
        more = {s for s in order if weight[s] * level > 3 * size[s]}
        if more == over:
            break
        over = more
    assert set(copies) <= set(before) and max(copies.values()) <= 3
    longest = max(len(split(r[1])) for r in before)
    assert all(abs(taken[s] - min(3 * size[s], weight[s] * level)) <= longest / 2 for s in order)


def plain_bounds(lengths, buckets):
    """The least padding that `buckets` bounds reach, by the quadratic program."""
    kinds = sorted(Counter(lengths).items())
    best = {0: 0}
    for _ in range(buckets):
        new = dict(best)
        for j in range(1, len(kinds) + 1):
            for i in range(j):
                if i in best:
                    cost = best[i] + sum(c * (kinds[j - 1][0] - n) for n, c in kinds[i:j])
                    new[j] = min(new.get(j, cost), cost)
        best = new
    return best[len(kinds)]


def test_packing_stage(steps):
    before, columns, after = steps[1]["packing"]
    rows = [dict(zip(columns, r)) for r in after]
    assert Counter((r["doc_id"], r["length"]) for r in rows) == Counter((r[0], len(split(r[1]))) for r in before)
    assert sum(r["padding"] for r in rows) == plain_bounds([r["length"] for r in rows], 16)
    held = defaultdict(list)
    for r in rows:
        assert r["padding"] == r["bound"] - r["length"] >= 0
        held[r["bucket"], r["batch"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in held.values())


def test_run_is_the_stages(spark, steps):
    at, out = steps
    assert Counter(map(tuple, corpus_pipeline.run(spark, at).collect())) == Counter(out["packing"][2])


def test_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def planted():
    """Texts of 120 words, and copies of them with 1 to 8 words changed or words added: similarities from about 0.6 to 0.97."""
    rng, out = random.Random(8), []
    for _ in range(12):
        base = [f"w{rng.randrange(9999)}" for _ in range(120)]
        out.append(" ".join(base))
        for n in range(1, 9):
            w = list(base)
            for at in rng.sample(range(120), n):
                w[at] = f"c{rng.randrange(9999)}"
            out.append(" ".join(w + ["tail"] * (n % 2)))
    return out


@pytest.mark.parametrize("crowded", [24, 2])
def test_near_copies_from_four_fifths(spark, monkeypatch, crowded):
    from larkspur.llm import jaccard

    monkeypatch.setattr(jaccard, "CROWDED", crowded)
    texts = planted()
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    root = classes(texts, alike)
    got = dict(corpus_pipeline.STAGES)["SimHash near-dedup"](spark, spark.createDataFrame(rows, DOCS), "")
    kept = sorted(r["doc_id"] for r in got.collect())
    assert kept == [i for i, k in enumerate(root) if i == k] and 12 < len(kept) < 100


def test_crowded_bands_leave_no_link_out(spark):
    """Of 150 texts that share 80 of 91 shingles, so that their bands are crowded, twelve pairs share one more and so are near copies."""
    from larkspur.llm import jaccard

    core = [f"w{i}" for i in range(84)]
    tails = [[f"p{k // 2}" if k < 24 else f"q{k}"] + [f"t{k}x{i}" for i in range(10)] for k in range(150)]
    texts = [" ".join(core + t) for t in tails]
    assert alike(texts[0], texts[1]) and not alike(texts[1], texts[2]) and not alike(texts[30], texts[31])
    got = jaccard.near_copies(spark.createDataFrame([(t,) for t in texts], "text string")).groupBy("root").count().collect()
    assert sorted(r["count"] for r in got) == [1] * 126 + [2] * 12


def test_copies_stage_with_null_and_shared_ids(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    rows = [(None, a), (None, b), (None, b), (5, c), (5, d), (3, c), (7, d), (None, d)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS)
    got = dict(corpus_pipeline.STAGES)["SimHash near-dedup"](spark, docs, "")
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == Counter([(None, a), (None, b), (3, c), (5, d)])


def test_far_from_every_anchor_yet_near_copies(spark):
    """Why the stage doesn't stop at SimHash: of planted pairs of similarity 0.8 or more few are within two bits."""
    from larkspur.llm.simhash import fingerprint

    texts, near, far = planted(), 0, 0
    for i, a in enumerate(texts):
        for b in texts[i + 1:i + 9]:
            if alike(a, b):
                bits = (fingerprint(a, 5) ^ fingerprint(b, 5)).bit_count()
                near, far = near + (bits <= 2), far + (bits > 2)
    assert far > 3 * near > 0 or near == 0 < far


#: Names that stages use inside, and a few that their results have.
INSIDE = ["_row", "_t", "_w", "_l", "_h", "n_words", "kept", "base_failed", "fails_length", "_key", "_copies", "_held", "_copy", "copies", "size", "rate", "_h1", "_h2",
          "id", "th", "tag", "root", "_doc", "_th", "_drop", "drop", "line", "no", "spot", "_id", "_text", "_rank", "source_size", "target", "n", "key", "a", "b", "x"]


def test_columns_of_every_inner_name_come_through(spark):
    """Each stage returns all columns with the values of their rows, ids that repeat or are null included."""
    base = [r for r in corpus() if r[1]] + [(None, corpus()[1][1] + " one more", "en", "s9", 0), (None, "An other text of the sea and of the land that is for all of us to see\nmenu", "en", None, 1), (5, corpus()[6][1], "en", "s0", 2)]
    rows = [(*r, *[f"{k}-{i}" for k in INSIDE]) for i, r in enumerate(base)]
    docs = spark.createDataFrame(rows, DOCS + ", " + ", ".join(f"{c} string" for c in INSIDE))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain = stage(spark, docs.select(*COLUMNS), "")
        got = [tuple(r) for r in stage(spark, docs, "").collect()]
        assert stage(spark, docs, "").columns == docs.columns
        seen = {r[5]: r for r in rows}
        for r in got:
            whole = seen[r[5]]
            assert r[5:] == whole[5:] and r[0] == whole[0] and r[2:5] == whole[2:5] and (name == "line dedup" or r[1] == whole[1]), name
        if name == "quality rules":
            assert Counter(r[:5] for r in got) == Counter(map(tuple, plain.collect()))


def test_equal_rows_mix_one_by_one(spark):
    text = " ".join(f"word{i}" for i in range(17))
    rows = [(1, text, "en", "s", 0)] * 5 + [(2, "a b c", "en", "s", 0), (2, "a b c", "en", "t", 0), (None, None, "en", "t", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    from larkspur.llm.common import n_words
    from larkspur.llm.mixing import mixed, stage_mixing

    words = sum(r["size"] * r["copies"] for r in mixed(docs, n_words("text")).collect())
    assert sum(len(split(r["text"])) for r in stage_mixing(spark, docs, "").collect()) == words


def test_run_leaves_one_folder(spark, steps, tmp_path):
    from pathlib import Path

    from larkspur.llm.common import shared_dir

    before = set(Path(shared_dir(spark)).glob("pipeline-*"))
    corpus_pipeline.run(spark, steps[0]).count()
    new = set(Path(shared_dir(spark)).glob("pipeline-*")) - before
    assert [sorted(p.name for p in x.iterdir()) for x in new] == [["4"]]


def test_few_edges_take_few_jobs(spark, monkeypatch):
    """Components of few edges take no rounds of small tasks, and are those that rounds find."""
    from larkspur.llm import common

    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(250)] + [(-5, 400), (7, 7), (500, 500)]
    frame = spark.createDataFrame(edges, "a long, b long")

    def run(group):
        spark.sparkContext.setJobGroup(group, group)
        got = common.components(frame)
        rows = sorted(map(tuple, got.collect()))
        spark.sparkContext.setJobGroup("", "")
        return got.schema.simpleString(), rows, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    kind, few, jobs = run("few")
    monkeypatch.setattr(common, "DRIVER_EDGES", 0)
    other, rounds, more = run("rounds")
    assert few == rounds and len(few) > 200 and kind == other and jobs < 8 < more


def test_gathered_rows_are_counted_and_merged(spark):
    from larkspur.llm.common import gathered, joined_small

    got = gathered(spark.range(0, 300, 1, 50).toDF("k"))
    assert got._rows == 300 and got.rdd.getNumPartitions() == 1 and gathered(spark.range(0, 300, 1, 50), 100).rdd.getNumPartitions() == 3
    assert gathered(spark.range(0))._rows == 0
    for limit in (300, 299):
        assert joined_small(spark.range(1000).toDF("k"), got, "k", "inner", limit).count() == 300
