"""Each text operator against brute force on small inputs with nulls, repeats, ties and clashing columns."""

import hashlib
import html
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import decontamination, html_text, line_dedup, mixing, near_dedup, quality_classifier, quality_rules, resharding, suffix_dedup, token_counts
from lattica.llm.components import components
from lattica.llm.tables import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n string, bands string, key string, anchor string"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    out = [prose(rng, rng.randint(30, 120)) for _ in range(25)]
    for base in out[:6]:
        for edits in (0, 1, 4, 9):
            w = base.split(" ")
            for _ in range(edits):
                w[rng.randrange(len(w))] = prose(rng, 1)
            out.append(" ".join(w))
    passage = prose(rng, 40)
    out += [prose(rng, 20) + " " + passage + " " + prose(rng, 15) for _ in range(5)]
    out += [None, "", " \n\t ", "one", "One", "two words", "TWO words", "a b c", "De " * 400, "x" * 5000, "x" * 5000 + "y", prose(rng, 8000), "line\nline\n\nline\n" * 10, "### $$$ %%% &&& " * 12]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", f"s{i % 4}" if i % 7 else None, len(t or ""), "x", "y", "z", "a") for i, t in enumerate(texts)]
    rows.append(rows[3])  # a repeated row
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="module")
def labels(spark, texts):
    return spark.createDataFrame([(i, 0 if i >= len(texts) - 3 else 1, 0) for i in range(len(texts))] + [(None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")


def shingles(text, n):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, 1))} if w else set()


@pytest.mark.parametrize("n", [2, 5])
def test_near_groups(docs, texts, n):
    sets = [shingles(t, n) for t in texts]
    group = list(range(len(texts)))
    for _ in range(len(texts)):
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    group[i] = group[j] = min(group[i], group[j])
    got = near_dedup.near_groups(docs, n).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        i = r["doc_id"]
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[i]), group[i], group[i] == i)


def test_near_groups_with_chains_and_null_ids(spark):
    rng = random.Random(2)
    base = prose(rng, 60).split(" ")
    rows = []
    for i in range(40):  # each step differs from the one before by little, the ends share nothing
        rows.append((100 - i, " ".join(base)))
        base[(3 * i) % 60] = prose(rng, 1)
    rows += [(None, rows[0][1]), (None, "alone at home")]
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert {r["component_id"] for r in got if r["doc_id"]} == {61}
    assert sorted(str(r["component_id"]) for r in got if r["doc_id"] is None) == ["61", "None"]


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2**63, 300).astype(np.uint64)
    sig = near_dedup.superminhash(np.concatenate([x[:200], x[100:]]), np.repeat([0, 1], 200), 3)
    assert abs((sig[0] == sig[1]).mean() - 1 / 3) < 0.15
    assert (sig[2] == np.uint64(2**64 - 1)).all()
    for s in sig[:2]:
        assert len(set(s.tolist())) == near_dedup.SLOTS
    small = near_dedup.superminhash(x[:1], np.zeros(1, int), 1)
    assert sorted((small[0] >> np.uint64(56)).tolist()) == list(range(near_dedup.SLOTS))  # one element visits each slot once


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 7), (200, 201), (5, 5)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(links, Scratch(spark)).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 0, 200: 200, 201: 200}


def test_components_of_a_long_chain_take_few_rounds(spark):
    ids = random.Random(1).sample(range(10_000), 400)
    scratch, rounds = Scratch(spark), []
    cut = scratch.cut
    scratch.cut = lambda df: rounds.append(df.columns == ["node", "parent"]) or cut(df)
    got = components(spark.createDataFrame(list(zip(ids, ids[1:])), "a long, b long"), scratch).collect()
    assert {tuple(r) for r in got} == {(i, min(ids)) for i in ids} and sum(rounds) <= 20


def test_three_texts_of_one_id_are_one_document(spark):
    rng = random.Random(8)
    rows = [(5, prose(rng, 40)), (5, prose(rng, 40)), (5, prose(rng, 40))]
    rows += [(i, rows[k][1]) for k, i in enumerate((7, 8, 9))]
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert {r["component_id"] for r in got} == {5}


def test_sketches_of_similar_sets(spark):
    assert near_dedup.least_equal(80) <= 0.8 * near_dedup.SLOTS and near_dedup.least_equal(100) == near_dedup.SLOTS
    x, y = 0x0123456789ABCDEF, 0x1123456789ABCDE0
    t = spark.createDataFrame([(x, y)], "x long, y long")
    assert t.select(near_dedup.equal_slots(F.col("x"), F.col("y"))).first()[0] == 14


def removed(texts, length):
    seen, out = {}, []
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - length + 1):
            if seen.setdefault(raw[p : p + length], (i, p)) != (i, p):
                gone[p : p + length] = True
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((len(raw), int(gone.sum()), int((np.diff(np.append(0, gone.astype(int))) > 0).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length,k", [(100, 32), (12, 4), (7, 3)])
def test_repeated_strings(docs, texts, length, k):
    want = removed(texts, length)
    got = suffix_dedup.repeated_strings(docs, length, k).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"]]
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"]


@pytest.mark.parametrize("batch", [1, 7, 10_000])
def test_repeated_strings_of_crowded_anchors(spark, batch):
    """Passages inside many different texts, and one 100-byte string in all of them: anchors of more runs than a
    block holds are cut around longer ones, and runs of one anchor lie in several batches."""
    rng = random.Random(12)
    word = "".join(rng.choices("abcdefgh ", k=300))
    texts = [prose(rng, 12) + word[: rng.randrange(110, 300)] + prose(rng, 12) for _ in range(60)] + [None, "", word, word]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
        want = removed(texts, 100)
        for block in (1, 20, 3000):
            got = suffix_dedup.repeated_strings(docs, block=block).collect()
            assert len(got) == len(texts)
            for r in got:
                assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"]]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("block", [1, 3000])
def test_repeated_strings_of_one_id_with_different_texts(spark, block):
    """Two texts of one doc_id hold the same run at the same place: both lose what stands in an earlier document."""
    rng = random.Random(5)
    p = "".join(rng.choices("abcdefgh ", k=140))
    ends = [f"{i}" + prose(rng, 30) for i in range(4)]
    rows = [(3, "zz " + p[:125] + ends[0]), (5, p + ends[1]), (5, p + ends[2]), (5, p + ends[2]), (9, p + ends[3])]
    got = suffix_dedup.repeated_strings(spark.createDataFrame(rows, "doc_id long, text string"), block=block).collect()
    removed_of = sorted((r["doc_id"], r["n_removed"]) for r in got)
    assert removed_of == [(3, 0), (5, 125), (5, 125), (5, 125), (9, 140)]


def test_recut_runs_hold_each_string_once(spark):
    """Each cut gives a run's strings to two runs at most, one by one around longer anchors, and ends at whole strings."""
    rng = random.Random(8)
    row = lambda i, at, many: (7, i, 0, 1000 * i, many, bytes(rng.choices(range(256), k=many + 99)), at, 32)
    rows = [row(1, 68, 69), row(2, 0, 1), row(3, 68, 1), row(4, 40, 30)]
    cut = spark.createDataFrame(rows, "anchor long, doc_id long, text_hash long, start long, many long, bytes binary, at int, core int")
    texts = {r[1]: r[5] for r in rows}
    strings = sorted((r[1], r[3] + i) for r in rows for i in range(r[4]))
    before = len(rows)
    for level in range(7):
        cut = spark.createDataFrame(suffix_dedup.recut(cut, 100).collect(), cut.schema)
        got = cut.collect()
        assert len(got) <= 2 * before
        before = len(got)
        assert sorted((r["doc_id"], r["start"] + i) for r in got for i in range(r["many"])) == strings
        for r in got:
            at = r["start"] - 1000 * r["doc_id"]
            assert bytes(r["bytes"]) == texts[r["doc_id"]][at : at + r["many"] + 99]
            assert r["at"] - r["many"] + 1 >= 0 and r["at"] + r["core"] <= 100
    assert all(r["core"] == 100 and r["many"] == 1 for r in got)


def test_transform_sorts_suffixes():
    rng = random.Random(4)
    for _ in range(20):
        strings = [np.array([rng.randrange(3) for _ in range(rng.randrange(1, 12))], np.uint16) for _ in range(rng.randrange(1, 6))]
        at, prefix = suffix_dedup.transform(strings, 200)
        ends, flat = np.cumsum([len(s) for s in strings]), np.concatenate(strings).tolist()
        suffix = [tuple(flat[a : ends[np.searchsorted(ends, a, "right")]]) for a in at]
        assert suffix == sorted(suffix) and len(suffix) == len(flat)
        for a, b, p in zip(suffix, suffix[1:], prefix[1:]):
            assert p == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_rule_statistics(docs, texts):
    def brute(t):
        t = t or ""
        w = WORD.findall(t)
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        again = {g for g in grams if grams.count(g) > 1} if len(w) < 2000 else set()
        hit = {i + k for i, g in enumerate(grams) if g in again for k in range(8)}
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(hit), sum("A" <= c <= "Z" for c in t), sum(c in "!?" for c in t), sum(a == b for a, b in zip(w, w[1:]))

    for r in quality_rules.rule_statistics(docs).collect():
        assert tuple(r)[2:] == brute(texts[r["doc_id"]])


def test_quality_rules(spark, docs, labels, texts):
    got = quality_rules.quality_rules(docs, labels).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        failed = r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]
        assert r["base_failed"] == failed and not (failed and r["kept"])
    odd = spark.createDataFrame([(i, prose(random.Random(i), 60) if i % 20 else prose(random.Random(i), 60).replace(" ", "### ")) for i in range(400)], "doc_id long, text string")
    truth = spark.createDataFrame([(i, int(i % 20 > 0)) for i in range(0, 400, 2)], "doc_id long, quality int")
    rows = quality_rules.quality_rules(odd, truth).collect()
    assert sum(r["kept"] for r in rows if r["doc_id"] % 20) >= 370 and not any(r["kept"] for r in rows if r["doc_id"] % 20 == 0)


def test_isolation_forest_finds_outliers():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, (500, 3)), [[9, 9, 9]]])
    score = quality_rules.anomaly(quality_rules.fit_forest(x), x)
    assert score.argmax() == 500 and score[500] > 0.6 > np.median(score)


def test_mixing(docs, texts):
    got = mixing.mixed(docs).collect()
    assert len(got) == len(texts) + 1
    size = lambda t: len(WORD.findall(t or ""))
    per: dict = {}
    for r in docs.select("source", "text").collect():
        per[r["source"]] = per.get(r["source"], 0) + size(r["text"])
    names = sorted((s for s in per if s is not None)) + [None]
    weight, budget, left, target = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}, 1.5 * sum(per.values()), set(names), {}
    while True:
        level = budget / sum(weight[s] for s in left)
        over = [s for s in left if level * weight[s] > 2 * per[s]]
        if not over:
            break
        for s in over:
            target[s], budget = 2.0 * per[s], budget - 2 * per[s]
            left.remove(s)
    target |= {s: level * weight[s] for s in left}
    taken: dict = {}
    of = {r["doc_id"]: r["source"] for r in docs.select("doc_id", "source").collect()}
    for r in got:
        assert r["size"] == size(texts[r["doc_id"]]) and 0 <= r["taken"] <= 2 * r["size"]
        s = of[r["doc_id"]]
        assert r["source_size"] == per[s] and abs(r["target"] - target[s]) < 1e-6
        taken[s] = taken.get(s, 0) + r["taken"]
    longest = max(size(t) for t in texts)
    assert all(abs(taken[s] - target[s]) <= longest for s in names)
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mixed(docs.repartition(3)).collect()))


def test_min_cost_flow():
    flow = resharding.min_cost_flow([10, 0, 5], [5, 5, 5], lambda i, j: int(i != j))
    assert [sum(r) for r in flow] == [10, 0, 5] and [sum(c) for c in zip(*flow)] == [5, 5, 5]
    assert sum(flow[i][j] for i in range(3) for j in range(3) if i != j) == 5
    rng = random.Random(1)
    for _ in range(20):
        supply = [rng.randrange(50) for _ in range(4)]
        capacity = [sum(supply) // 5 + (j < sum(supply) % 5) for j in range(5)]
        f = resharding.min_cost_flow(supply, capacity, lambda i, j: int(i != j))
        assert sum(f[i][i] for i in range(4)) == sum(min(s, c) for s, c in zip(supply, capacity))  # all that can stays


def test_reshard_and_rewrite(spark, docs, texts, tmp_path):
    old = F.crc32(F.coalesce("source", F.lit(""))) % 3
    placed, transfers = resharding.reshard(docs, old, 3, 4)
    rows = placed.collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(raw) + 1 and r["text_crc32"] == zlib.crc32(raw)
    for s in range(4):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    total = [sum(r["size"] for r in rows if r["shard"] == s) for s in range(4)]
    assert max(total) - min(total) <= 2 * max(r["size"] for r in rows)
    one = docs.dropDuplicates(["doc_id"])
    placed, transfers = resharding.reshard(one, old, 3, 4)
    done = resharding.rewrite_affected(one, placed, transfers, f"file://{tmp_path}/shards")
    back = spark.read.parquet(f"file://{tmp_path}/shards")
    assert set(done) == {r["shard"] for r in back.select("shard").distinct().collect()}
    assert back.count() == placed.where(F.col("shard").isin(done)).count()


def test_rewrite_every_row_once(spark, tmp_path):
    """Null ids and ids with several rows are written once each; files of other shards stay, of emptied ones go."""
    path = f"file://{tmp_path}/shards"
    docs = spark.createDataFrame([(None if i % 5 == 0 else i // 4, f"text {i} " * (i % 7), "en", i % 3) for i in range(120)] + [(7, "same", "de", 2)] * 3, "doc_id long, text string, lang string, at int")
    spark.range(1).selectExpr("'old' as text", "explode(array(1, 2, 9)) as shard").write.partitionBy("shard").parquet(path)
    placed, transfers = resharding.reshard(docs, F.col("at"), 3, 2)
    assert resharding.rewrite_affected(docs, placed, transfers, path) == [0, 1, 2]
    back = spark.read.parquet(path)
    assert [r["text"] for r in back.where("shard = 9").collect()] == ["old"] and back.where("shard = 2").count() == 0
    rows = lambda df: sorted(map(repr, df.select(*docs.columns).collect()))
    assert rows(back.where("shard < 9")) == rows(docs)
    for s in range(2):
        slots = [r["slot"] for r in back.where(F.col("shard") == s).collect()]
        assert sorted(slots) == list(range(len(slots)))
    got = resharding.resharded(docs, F.col("at"), 3, 2)
    assert sorted(map(repr, got.select("doc_id", "size", "text_crc32", "old_shard", "shard", "slot").collect())) == sorted(map(repr, placed.select("doc_id", "size", "text_crc32", "old_shard", "shard", "slot").collect()))
    assert any("/shards/shard=" in f for f in got.inputFiles())
    stays = resharding.resharded(docs, F.when(F.col("at") == 0, 0).otherwise(1), 2, 3, [sum(len((r["text"] or "").encode()) + 1 for r in docs.where("at = 0").collect()), 200, 10**6])
    assert stays.count() == 123 and {r["shard"] for r in stays.select("shard").distinct().collect()} == {0, 1, 2}


def test_contaminated(spark, docs, texts):
    rng = random.Random(9)
    items = [(0, " ".join(texts[2].split(" ")[3:28])), (1, prose(rng, 30)), (2, texts[49].upper()[:200]), (3, "two words"), (4, None), (5, ""), (None, "one"), (6, "one"), (0, " ".join(texts[2].split(" ")[3:28]))]
    bench = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, doc_id string")
    got = {(r["doc_id"], r["item_id"]): (r["n_item"], r["n_shared"]) for r in decontamination.contaminated(docs, bench).collect()}
    want = {}
    for i, t in items:
        a = shingles(t, 5)
        for d, x in enumerate(texts):
            both = len(a & shingles(x, 5))
            if i is not None and a and 100 * both >= 80 * len(a):
                want[d, i] = len(a), both
    assert got == want and (2, 0) in got


def test_line_dedup(spark):
    page = lambda i, extra="": f"<html><nav>Menu</nav><p>text {i} here</p>{extra}<footer>Foot &copy;</footer><script>var a='<p>';</script></html>"
    rows = [(i, "http://A.com/x", page(i, "<p>half</p>" if i < 2 else ""), "q") for i in range(4)] + [(9, "https://b.org", page(9), "q"), (10, None, None, "q"), (11, "nonsense", "", "q"), (0, "http://a.com/x", page(0), "q")]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "page_id long, url string, html string, host string")).collect()
    assert len(got) == 8
    by = {r["page_id"]: r for r in got if r["page_id"]}
    assert by[1]["kept_text"] == "text 1 here\nhalf" and by[1]["host"] == "a.com" and by[1]["host_pages"] == 5 and by[1]["n_removed"] == 2
    assert by[9]["kept_text"] == "Menu\ntext 9 here\nFoot &copy;" and by[10]["n_lines"] == 0 == by[11]["n_lines"]


def test_line_dedup_against_brute_force(spark):
    """Lines cut by a scan of characters; a bare < and > are text, ties at the ratio stay, very long lines too."""
    rng = random.Random(6)
    stock = ["3 < 5 holds", "a > b <c", "x" * 5_000, "menu", "foot & co", "<b>bold</b> line", "one <i>two</i> three < four"]
    pages = [(i, f"http://h{i % 4}.org/{i}", "<p>".join(rng.choice(stock) + (f" {i}" if rng.random() < 0.3 else "") for _ in range(rng.randint(0, 6)))) for i in range(60)]
    pages += [(60, "http://two.org", "same\nown 1"), (61, "http://two.org", "own 2\nsame"), (62, "http://one.org", "same\n3 < 5 holds\nsecond line\nthird line\n<b>x</b> end")]

    def lines(text):
        out, at = "", 0
        while at < len(text):
            end = text.find(">", at)
            if text[at] == "<" and at + 1 < len(text) and text[at + 1] in "/!pbi" and end > 0 and "<" not in text[at + 1 : end]:
                out, at = out + ("\n" if text[at:end].strip("</") == "p" else ""), end + 1
            else:
                out, at = out + text[at], at + 1
        return [x.strip(" ") for x in out.split("\n") if x.strip(" ")]

    host = lambda url: url.split("/")[2]
    of, cut = {}, [lines(text) for _, _, text in pages]
    for (_, url, _), own in zip(pages, cut):
        of.setdefault(host(url), []).append(set(own))
    got = line_dedup.line_dedup(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    for r in got:
        url, own = pages[r["page_id"]][1], cut[r["page_id"]]
        sets = of[host(url)]
        times = lambda x: sum(x in s for s in sets)  # noqa: B023, E731
        kept = [x for x in own if not (times(x) >= 2 and times(x) > 0.5 * len(sets))]
        assert (r["kept_text"], r["n_lines"], r["n_removed"]) == ("\n".join(kept), len(own), len(own) - len(kept))
    by = {r["page_id"]: r["kept_text"] for r in got}
    assert by[60] == "own 1" and by[62] == "same\n3 < 5 holds\nsecond line\nthird line\nx end"


def test_main_text(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><a href=/>Home</a></header><nav><ul><li><a href=a>One</a></ul></nav>
    <div class="cookie-notice">We use cookies</div><article><h1>A title &amp; more</h1><p>First  <b>bold</b> text
    of &lt;this&gt; page.<br>Second line<p>Short.</p><script>var x="</p>"</script></article><aside class=x>See also this other story</aside>
    <div id="comments"><p>Nice article, I read it twice and then once more with friends.</p></div><form><label>Mail</label></form><footer>&copy; us</footer></body></html>"""
    rows = [(1, "u", page, "x"), (2, None, None, "x"), (3, "u", "", "x"), (None, "u", "<p>" + "word " * 5000 + "</p>", "x"), (1, "u", page, "x"), (5, "u", "<<<>><a <b", "x")]
    got = html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(got) == 6
    assert got[0]["text"] == "A title & more\nFirst bold text of <this> page. Second line\nShort." and got[0]["n_chars"] == len(got[0]["text"])
    assert got[0] == got[4] and got[1]["text"] == got[2]["text"] == "" and got[3]["n_chars"] == 24999


def words(n, at=0):
    return " ".join(f"w{at + i}" for i in range(n))


#: Pages without an article element; the parts between { and } are the main text.
TEMPLATES = [
    "<body><div class=top><a href=/>Home</a></div><ul><li><a href=a>One two</a><li><a href=b>Three</a></ul><div>{<h2>A title here</h2>}{<p>%30</p>}{<p>%55</p>}{<p>%4</p>}{<p>%48</p>}</div><div><a href=x>Next page</a></div><div><a href=y>Older posts</a></div><div>All rights kept by us</div></body>",
    "<form id=aspnetForm><div id=menu><a href=a>One</a></div><div class=entry-content>{<h1>Some title words</h1>}{<p>%44</p>}{<p>%3</p>}{<p>%60</p>}</div><div class=sidebar-right><p>%40</p></div><div id=comments><div class=post><p>%50</p></div></div></form>",
    "<table><tr><td><a href=a>Start</a><td><a href=b>Contact us</a></tr></table><table><tr><td>{%120}<tr><td>{%80}</table><center><a href=c>Imprint here</a></center>",
    "<div class=cookie-notice>%25</div><div class='share-friendly body'>{<h1>T u v</h1>}{<p>%35</p>}{<ul><li>%4</li>}{<li>%5</li></ul>}{<p>%70 <a href=l>a link</a> %9</p>}</div><footer><p>%30</p></footer>",
    # A blog: what the body and the article are like is said in words that elsewhere name other parts.
    "<body class='single no-sidebar'><div class=site-header><a href=/>Blog</a></div><nav><a href=a>About</a></nav><div class='content with-sidebar'><article class='post category-social tag-legal'>{<h1>%6</h1>}{<p>%50</p>}{<p>%33</p>}{<p>%41</p>}</article></div><footer>%9</footer></body>",
    "<body class='page has-sidebar sidebar-right'><div id=page><ul class=menu><li><a href=a>%1</a><li><a href=b>%2</a></ul><div class=post>{<h2>%7</h2>}{<p>%62</p>}{<p>%5</p>}{<p>%48</p>}</div><div id=sidebar><h3>%2</h3><p>%30</p></div></div></body>",
    # A shop's news: all of it in a container of a misleading name.
    "<div class='promo'><div class=row>{<h1>%6</h1>}{<p>%70</p>}{<p>%44</p>}{<p>%9</p>}{<p>%52</p>}</div></div>",
    # An encyclopedia: lists of links, footnotes and a table inside.
    "<div id=mw-navigation><ul><li><a href=a>%2</a><li><a href=b>%2</a></ul></div><article>{<h1>%3</h1>}{<p>%60 <a href=x>%3</a> %20</p>}{<ul><li><a href=c>%2</a></li>}{<li><a href=d>%3</a></li></ul>}{<p>%50</p>}<section class=footnotes>{<ol><li>%9 <a href=e>%1</a></li>}{<li>%7</li></ol>}</section></article><div id=footer><ul><li>%8</ul></div>",
    # Readers under a heading, without names for it.
    "<article>{<h1>%7</h1>}{<p>%80</p>}{<p>%41</p>}{<p>%39</p>}</article><div><h3>12 Comments</h3><div><b>Jane Doe says:</b><p>%30</p><a href=r>Reply</a></div><div><b>Tom wrote:</b><p>%45</p><a href=r>Reply</a></div></div><footer><p>%6</p></footer>",
    "<div class=wrap><h1>{%6}</h1>{<p>%66</p>}{<p>%48</p>}{<p>%57</p>}<div><h2>Leave a reply</h2><p>Ana Ruiz, 3 days ago</p><p>%24</p><p>Reply</p></div></div>",
    # Notices over and under the page.
    "<div class='cc-window cc-banner'><p>%28</p><a href=o>%1</a></div><div class=gdpr-overlay><p>%40</p></div><main>{<h1>%5</h1>}{<p>%58</p>}{<p>%4</p>}{<p>%61</p>}</main><div id=cookie-notice>%35</div>",
    # A forum of article elements for comments, inside the main one's page.
    "<main><article class=story>{<h1>%6</h1>}{<p>%55</p>}{<p>%40</p>}</article><section class=comment-list><article class=comment><p>%50</p></article><article class='comment comment-author-x'><p>%35</p></article></section></main>",
    # A magazine: sharing, byline and related lists around paragraphs.
    "<header class=masthead><a href=/>%2</a></header><div class=article-body>{<h1>%8</h1>}{<p>%64</p>}<div class=social-share><a href=f>%1</a><a href=t>%1</a></div>{<p>%37</p>}<aside class=related-stories><a href=q>%6</a></aside>{<p>%59</p>}{<h2>%3</h2>}{<p>%45</p>}</div><section class=newsletter-signup><p>%20</p></section>",
    "<main class='form-design page'>{<h1>Five words in this title</h1>}{<p>%33</p>}{<address>%6</address>}<svg viewBox=x /><select name=q><option>A<option>B</select><button-group></button-group>{<p>%41</p>}<object data=z />{<p>%52</p>}<div class='newsletter-box'><p>%12</p><button>Join</div></main><aside><h3>More</h3><p>%20</p></aside>",
]


@pytest.mark.parametrize("number", range(len(TEMPLATES)))
def test_main_text_of_other_templates(number):
    page = re.sub(r"%(\d+)", lambda m: words(int(m[1]), m.start()), TEMPLATES[number])
    want = [" ".join(re.sub("<[^>]*>", " ", x).split()) for x in re.findall(r"\{(.*?)\}", page, re.S)]
    found = html_text.blocks(page.replace("{", "").replace("}", ""))
    tree = html_text.fit_tree(html_text.labelled_rows())
    kept = html_text.classify(tree, html_text.block_features(found))
    assert [b[0] for b, k in zip(found, kept) if k] == want


def test_blocks_of_broken_markup_in_linear_time():
    for inside in ("<svg width=1/>", "<object data=x />", "<div><select><option>A</div>", "<div><button>B</div>", "<title-bar>", "<button-group>"):
        assert [b[0] for b in html_text.blocks(f"<article><p>one</p>{inside}<p>two</p></article>")] == ["one", "two"]
    assert html_text.blocks("<p>a<script>x") == [("a", 1, 0, 0, 0)]
    deep = "<div>" * 60_000 + "x" + "</p></section>" * 60_000
    assert len(html_text.blocks(deep)) == 1


def test_link_density_and_words_decide_without_hints():
    tree = html_text.fit_tree(html_text.labelled_rows())
    x = np.array(html_text.labelled_rows())
    plain = x[x[:, 6] == 0]
    none = plain.copy()
    none[:, :6] = 0
    right = lambda t: (html_text.classify(tree, t[:, :-1]) == plain[:, -1]).mean()
    assert right(plain) > 0.95 and right(none) < 0.8


def test_a_hint_is_no_veto():
    """What a page calls outside is judged by words and links where the page has nothing better."""
    tree = html_text.fit_tree(html_text.labelled_rows())
    page = [("t", n, 0, hint, n == 7) for n, hint in ((7, -2), (60, -2), (45, -2), (50, -2))]
    assert html_text.classify(tree, html_text.block_features(page)).all()
    better = [("t", n, 0, 0, n == 7) for n in (7, 60, 45, 50)]
    assert html_text.classify(tree, html_text.block_features(better + page[1:])).tolist() == [True] * 4 + [False] * 3
    for attributes in (" class='single no-sidebar'", " class='post category-social'", " id='tag-legal'", " class='not-comments'"):
        assert html_text.hint("div", attributes, 0) >= 0
    assert html_text.hint("article", " class='comment odd'", 2) == -2 and html_text.hint("div", " class=cc-window", 0) == -2


def test_tree_on_held_out_pages_of_the_table():
    """Fitted on four fifths of the labelled pages, the tree is right on most blocks of the others."""
    lines = [x for x in html_text.LABELLED.split("\n") if x]
    right = []
    for k in range(5):
        tree = html_text.fit_tree(html_text.labelled_rows("\n".join(x for i, x in enumerate(lines) if i % 5 != k)))
        held = np.array(html_text.labelled_rows("\n".join(lines[k::5])))
        right += (html_text.classify(tree, held[:, :-1]) == held[:, -1]).tolist()
    assert np.mean(right) > 0.85


def test_main_text_on_held_out_pages(spark):
    """Against the article elements of the given pages, none of which the labelled table was drawn from."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    want = {}
    for r in pages.collect():
        inside = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1].replace("<br>", " ")
        want[r["page_id"]] = "\n".join(x for x in (" ".join(html.unescape(re.sub("<[^>]*>", "", p)).split()) for p in re.split(r"</?(?:p|h1)>", inside)) if x)
    got = {r["page_id"]: r["text"] for r in html_text.main_text(pages).collect()}
    assert got == want


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_section_tokens(docs, texts, rule):
    """Each token's section by a walk over its bytes."""
    tokenizer, lengths = token_counts.encoding(token_counts.VOCABULARY, token_counts.PATTERN)
    got = {(r["doc_id"], r["section"]): tuple(r)[2:] for r in docs.dropDuplicates(["doc_id"]).transform(lambda t: token_counts.section_tokens(t, rule=rule)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        section = np.append(0, np.cumsum([b == 10 for b in raw]))[: len(raw)]  # of each byte
        n, cross, at = [0] * (int(section[-1]) + 1 if raw else 1), [0] * (int(section[-1]) + 1 if raw else 1), 0
        for token in tokenizer.encode_ordinary(t or ""):
            inside = section[at : at + lengths[token]].tolist()
            at += lengths[token]
            own = {"first": inside[0], "last": inside[-1], "largest": max(sorted(set(inside)), key=inside.count)}[rule]
            n[own] += 1
            cross[own] += len(set(inside)) > 1
        size = np.bincount(section, minlength=len(n)).tolist() if raw else [0]
        for s in range(len(n)):
            assert got.pop((i, s)) == (size[s], n[s], cross[s])
    assert not got


def test_tokens_of_long_white_space_and_no_utf8():
    tokenizer, lengths = token_counts.encoding(token_counts.VOCABULARY, token_counts.PATTERN)
    for blank in (" ", "\n", " \t", "\u3000 \n"):
        for text in (blank * 12_000, "a" + blank * 12_000 + "b c", "a " + blank * 12_000 + " !x", blank * 12_000 + "\n7", "é" + blank * 11_000 + "q" + blank * 30_000):
            assert token_counts.tokens_of(tokenizer, text.encode()).tolist() == tokenizer.encode_ordinary(text)
        for text in (blank * 300_000, "a" + blank * 1_000_000 + "b"):
            assert lengths[token_counts.tokens_of(tokenizer, text.encode())].sum() == len(text.encode())
    raw = b"ab\xff\xfe c" + "d é".encode() + b"\xc3"
    assert lengths[token_counts.tokens_of(tokenizer, raw)].sum() == len(raw)


def test_boundary_rules():
    ends, cuts = np.array([4, 10]), np.array([0, 5])
    assert [token_counts.attributed(ends, cuts, r)[0].tolist() for r in token_counts.RULES] == [[2, 0], [1, 1], [1, 1]]
    assert token_counts.attributed(ends, cuts, "first")[1].tolist() == [1, 0]


def test_quality_classifier(spark, docs, labels, texts):
    got = quality_classifier.quality_classifier(docs, labels).collect()
    assert len(got) == len(texts) + 1
    rng = random.Random(3)
    rows = [(i, prose(rng, 50) if i % 5 else "!!! ".join(prose(rng, 40).upper().split(" ")), "en" if i % 3 else None, "web", 300) for i in range(300)]
    truth = spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(0, 300, 2)], "doc_id long, quality int")
    kept = {r["doc_id"]: r["kept"] for r in quality_classifier.quality_classifier(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), truth).collect()}
    held = [i for i in range(1, 300, 2)]
    assert np.mean([kept[i] == (i % 5 > 0) for i in held]) > 0.97
    assert all(r["kept"] for r in quality_classifier.quality_classifier(docs, labels.limit(0)).collect())


def test_sparse_view_against_dense_columns():
    rng = np.random.default_rng(5)
    dense, words = rng.normal(size=(40, 3)), rng.poisson(0.2, (40, 16)).astype(float)
    rows, slots = np.nonzero(words)
    view = quality_classifier.View(dense, 16, rows, slots, words[rows, slots])
    at = rng.permutation(40)[:25]
    plain = np.column_stack([dense, words, np.ones(40)])[at]
    beta, v = rng.normal(size=20), rng.normal(size=25)
    part = view.take(at)
    assert np.allclose(part.times(beta), plain @ beta)
    assert np.allclose(part.back(v), v @ plain) and np.allclose(part.back(v, 2), v @ plain**2)
    # The fit ends where the gradient of the ridge's loss is zero.
    y = (rng.random(25) < 0.4).astype(float)
    got = quality_classifier.fit_logistic(part, y)
    w = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    assert np.abs(plain.T @ (w * (1 / (1 + np.exp(-plain @ got)) - y)) + 1e-3 * got).max() < 1e-5


def test_quality_classifier_learns_wording(spark):
    """Documents that are bad by their wording alone, out of 100,000 words: more slots tell more of them apart."""
    rng = np.random.default_rng(11)
    rows, truth = [], []
    for i in range(2400):
        at = rng.integers(0, 100_000, 120)
        if i % 2:
            at[:14] = rng.integers(0, 300, 14)
        rows.append((i, " ".join(f"w{w:06d}" for w in rng.permutation(at)), "en", "web", 1000))
        truth += [(i, 1 - i % 2)] * (i % 3 > 0)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame(truth, "doc_id long, quality int")
    right = {}
    for slots in (256, quality_classifier.WORD_SLOTS):
        got = quality_classifier.quality_classifier(docs, labels, word_slots=slots).collect()
        right[slots] = np.mean([(r["text_margin"] > 0) == (r["doc_id"] % 2 == 0) for r in got if r["doc_id"] % 3 == 0])
    assert right[quality_classifier.WORD_SLOTS] > 0.95 and right[quality_classifier.WORD_SLOTS] > right[256] + 0.05, right


def test_empty_tables(spark, docs, labels):
    none = docs.limit(0)
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert near_dedup.near_groups(none).count() == 0
    assert suffix_dedup.repeated_strings(none).count() == 0
    assert quality_rules.quality_rules(none, labels).count() == 0 == quality_rules.quality_rules(none, labels.limit(0)).count()
    assert quality_classifier.quality_classifier(none, labels).count() == 0
    assert mixing.mixed(none).count() == 0 == token_counts.section_tokens(none).count()
    assert resharding.reshard(none, F.lit(0), 1)[0].count() == 0
    assert decontamination.contaminated(none, bench).count() == 0 == decontamination.contaminated(docs, bench).count()
    assert line_dedup.line_dedup(pages).count() == 0 == html_text.main_text(pages).count()


def test_classifier_takes_each_id_once(spark, monkeypatch):
    """Thousands of rows of one id, with different texts: a sample of distinct ids, the same in each run."""
    rng = random.Random(3)
    good, bad = ("river stone", "!!! $$$")
    rows = [(i, f"{good if i % 2 else bad} {prose(rng, 30)}", "en", "s", 50) for i in range(120)]
    rows += [(200, prose(rng, 20), "en", "s", 50) for _ in range(3000)] + [(1, good + prose(rng, 20), "en", "s", 50) for _ in range(50)]
    truth = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, quality int")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    seen = []
    monkeypatch.setattr(quality_classifier, "co_train", lambda both, y, f=quality_classifier.co_train: seen.append(len(y)) or f(both, y))
    runs = [sorted((r["doc_id"], r["score"]) for r in quality_classifier.quality_classifier(docs.repartition(n), truth, pool_rows=15).collect()) for n in (2, 7)]
    assert seen == [115, 115] and len(runs[0]) == len(rows)
    assert np.allclose([s for _, s in runs[0]], [s for _, s in runs[1]])


@pytest.mark.parametrize("length", [128, 257, 509])
def test_repeats_of_other_lengths(length):
    """Lengths that symbols of several bytes don't divide: two equal runs repeat at each of their places."""
    rng = np.random.default_rng(length)
    run = rng.integers(0, 256, length + 50, np.uint8).tobytes()
    owner, offset = suffix_dedup.repeats([(1, 0, 51, run), (2, 7, 51, run)], length)
    assert sorted(zip(owner.tolist(), offset.tolist())) == [(1, i) for i in range(51)]


def test_limits_of_arguments(docs):
    with pytest.raises(ValueError):
        near_dedup.near_groups(docs, percent=50)
    for length in (32, 1 << 16):
        with pytest.raises(ValueError):
            suffix_dedup.repeated_strings(docs, length)


def test_token_counts_of_many_short_blanks(spark):
    """A text of white-space runs just under ten thousand takes no square of them."""
    import time

    text = ("a" + " " * 9999) * 30 + "b\n" + "\t" * 70
    began = time.time()
    tokenizer, _ = token_counts.encoding(token_counts.VOCABULARY, token_counts.PATTERN)
    got = token_counts.tokens_of(tokenizer, text.encode())
    assert tokenizer.decode(got.tolist()) == text and time.time() - began < 10
    for t in ("x" + " " * 63 + "y", "x" + " " * 64 + "y", "x" + " " * 65 + "y", " " * 100, "\n" * 70 + "z"):
        assert token_counts.tokens_of(tokenizer, t.encode()).tolist() == tokenizer.encode(t)


def test_items_of_one_opening(spark):
    """A thousand items that begin alike: documents with the opening meet none of them, those with an item its own."""
    rng = random.Random(8)
    opening = prose(rng, 20)
    items = [(i, f"{opening} {prose(rng, 25)}") for i in range(1000)]
    docs = [(i, f"{prose(rng, 30)} {opening} {prose(rng, 40)}") for i in range(60)] + [(100 + i, f"{prose(rng, 9)} {items[i * 9][1]} {prose(rng, 9)}") for i in range(40)]
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contaminated(docs, items)
    assert sorted((r["doc_id"], r["item_id"], r["containment"]) for r in got.collect()) == [(100 + i, i * 9, 1.0) for i in range(40)]
    sets = decontamination.item_sets(items, 5).distinct()
    held = decontamination.item_sets(docs.toDF("item_id", "text"), 5).groupBy(F.col("item_id").alias("doc_id")).agg(F.collect_list("shingle").alias("shingles"))
    assert 40 <= decontamination.rare_meetings(held, sets, 80).count() < 100  # and chance meetings


def test_verdicts_by_a_plain_forest(spark, docs, labels):
    """Path lengths by walking each tree, the threshold by trying each, and the verdicts that follow."""
    stats = sorted((r.asDict() for r in quality_rules.rule_statistics(docs).collect() if r["n_words"] >= 20), key=lambda r: [r["doc_id"], *[r[c] for c in quality_rules.COUNTS]])
    pick = lambda rows: quality_rules.features(lambda c: np.array([float(r[c]) for r in rows]))
    trees, usual = quality_rules.fit_forest(pick(stats))

    def steps(tree, x):
        feature, split, left, right, length = tree
        at = 0
        while left[at] >= 0:
            at = left[at] if x[feature[at]] <= split[at] else right[at]
        return length[at]

    rows = [r.asDict() for r in quality_rules.rule_statistics(docs).collect()]
    score = [2.0 ** -(sum(steps(t, x) for t in trees) / len(trees) / usual) for x in pick(rows)]
    failed = [r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"] for r in rows]
    truth = {(r["doc_id"], r["quality"]) for r in labels.collect() if r["doc_id"] is not None and r["quality"] is not None}
    known = [(s, q) for r, s, f in zip(rows, score, failed) if not f for i, q in truth if i == r["doc_id"]]
    good, bad = ([s for s, q in known if (q > 0) == wanted] for wanted in (True, False))
    limit, best = 0.75, -1.0
    if good and bad:
        for k in range(quality_rules.BINS + 2):
            lost, found = (sum(int(s * quality_rules.BINS) >= k for s in part) / len(part) for part in (good, bad))
            if lost <= quality_rules.GOOD_LOSS and found - lost > best:
                limit, best = k / quality_rules.BINS, found - lost
    want = sorted((r["doc_id"], r["text_hash"], f, not f and s < limit) for r, s, f in zip(rows, score, failed))
    got = quality_rules.quality_rules(docs, labels).collect()
    assert sorted((r["doc_id"], r["text_hash"], r["base_failed"], r["kept"]) for r in got) == want
    assert np.allclose(sorted(r["anomaly"] for r in got), sorted(score))


def test_scores_by_the_two_margins(docs, labels):
    """The calibrated score is one affine function of both views' margins for all rows."""
    rows = quality_classifier.quality_classifier(docs, labels).collect()
    x = np.array([[r["text_margin"], r["meta_margin"], 1.0] for r in rows])
    y = np.array([np.log(r["score"] / (1 - r["score"])) for r in rows])
    inner = np.abs(y) < 20
    scale = np.linalg.lstsq(x[inner], y[inner], rcond=None)[0]
    assert np.allclose(x[inner] @ scale, y[inner], atol=1e-6) and scale[0] >= 0


def test_placement_one_row_after_the_other(docs):
    """Shards and slots by a walk over the rows of each old shard in hashed order."""
    old = F.crc32(F.coalesce("source", F.lit(""))) % 3
    placed, transfers = resharding.reshard(docs, old, 3, 5)
    rows = [r.asDict() for r in placed.withColumn("draw", F.xxhash64("doc_id", "text_crc32")).drop("row").collect()]
    slots = dict.fromkeys(range(5), 0)
    place = lambda r: (r["block"], r["draw"], (r["doc_id"] is not None, r["doc_id"] or 0), r["text_crc32"], r["size"])
    for i in range(3):
        runs = sorted(((b, j) for a, j, b in transfers if a == i), key=lambda t: (t[1] != i, t[1]))
        ends = np.cumsum([b for b, _ in runs])
        at = 0
        for r in sorted((r for r in rows if r["old_shard"] == i), key=place):
            r["want"] = runs[int(np.searchsorted(ends, at + r["size"] / 2, "right"))][1]
            at += r["size"]
        assert at == (ends[-1] if len(ends) else 0)
    for r in sorted(rows, key=lambda r: (r["old_shard"], *place(r))):
        assert (r["shard"], r["slot"]) == (r["want"], slots[r["want"]])
        slots[r["want"]] += 1
