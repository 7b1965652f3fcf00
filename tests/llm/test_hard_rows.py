"""Repeated rows, nulls and hostile input over several partitions; plain versions of what the operators decide."""

import itertools
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearmark.llm import decontaminate, html_wrapper, line_crf, minhash, mixing, quality_rules, secret_scan, token_counts
from nearmark.llm.common import Workspace
from nearmark.llm.shingles import WordHashes, sequence_hashes

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def folded(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def spread(spark, rows, schema=SCHEMA, n=4):
    """The rows one after the other over n partitions, so that equal ones lie apart."""
    return spark.createDataFrame(spark.sparkContext.parallelize([r for k in range(n) for r in rows[k::n]], n), schema)


def text(name, n=40):
    return " ".join(f"{name}{i}" for i in range(n))


@pytest.fixture(scope="module")
def rows():
    a, b = text("a"), text("b")
    near_a = a.replace("a39", "other")
    out = [(1, a), (2, near_a), (2, b), (2, b), (3, b), (None, b), (None, a), (None, text("n")), (None, text("n")), (7, None), (7, None), (8, ""), (9, text("u")), (9, text("u")), (9, text("v"))]
    return [(i, t, None if k % 3 else "en", ("x", "y", None)[k % 3], None if t is None else len(t)) for k, (i, t) in enumerate(out)]


def plain_near(rows):
    """Of each component the row of smallest (doc_id, null last); texts without words all stay."""
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := words(folded(r[1]))) else frozenset() for r in rows]
    group = list(range(len(rows)))
    for _ in rows:
        for i, j in itertools.product(range(len(rows)), repeat=2):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                group[i] = group[j] = min(group[i], group[j])
    members = defaultdict(list)
    for r, s, g in zip(rows, sets, group, strict=True):
        members[g].append((r, s))
    return [[x[0] for x in m] for m in members.values()], sets


def test_one_of_each_group_stays(spark, rows):
    kept = [tuple(r) for r in minhash.one_of_each(spark, spread(spark, rows)).collect()]
    groups, _ = plain_near(rows)
    left = Counter(kept)
    assert len(kept) == len(groups)
    for g in groups:
        least = min((r[0] for r in g if r[0] is not None), default=None)
        stays = [r for r in set(g) if r[0] == least and left[r]]
        assert len(stays) == 1
        left[stays[0]] -= 1
    assert {r[0] for r in kept if r[1] == text("v")} == {9}


def test_near_columns_clash(spark, rows):
    docs = spread(spark, rows).withColumns({"node": F.lit(1), "rid": F.lit(2), "_rest": F.lit(3), "kept": F.lit(4)})
    out = minhash.one_of_each(spark, docs)
    assert out.columns == docs.columns and out.agg(F.sum("node") + F.sum("rid") * 0).first()[0] == out.count()


def plain_mix(rows):
    """Words taken of each row by complete epochs and smallest keys."""
    import hashlib
    import math

    def key(r):
        t = r[1] or ""
        q = max(0.1, 1.0 - 4.0 * len(re.findall(r"[#*$%&|<>]", t)) / max(len(t), 1))
        digits = int(hashlib.md5((str(r[0]) if r[0] is not None else t).encode()).hexdigest()[:13], 16)
        return -math.log((digits + 0.5) / 4503599627370496.0) / q

    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, free, rest = {}, set(order), 1.5 * sum(sizes.values())
    while free:
        share = {s: weight[s] * rest / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] >= 2 * sizes[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            rest -= target[s]
            free.remove(s)
    out = []
    for s in order:
        own = sorted((key(r), r[0] is not None, r[0] or 0, r[1] or "", k) for k, r in enumerate(rows) if r[3] == s)
        epochs = int(target[s] // sizes[s]) if sizes[s] else 0
        left, upto = target[s] - epochs * sizes[s], 0
        for *_, k in own:
            n = len(words(rows[k][1]))
            more = left > 0 and (upto + n <= left or (upto < left and upto + n - left < left - upto))
            upto += n
            out.append((rows[k][0], rows[k][1], s, n, sizes[s], round(target[s], 6), n * (epochs + more)))
    return out


def test_mix_documents_plain(spark, rows):
    """Rows alike but for their source count in their own; equal rows are rows of their own."""
    rows = [*rows, *[(1, rows[0][1], "en", s, 5) for s in ("x", "y", "z", None)]]
    docs = spread(spark, rows).withColumns({"size": F.lit("s"), "key": F.lit(1), "part": F.lit(2), "_doc": F.lit(3)})
    got = mixing.mix_documents(spark, docs)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "key", "part", "_doc", "copies", "size", "source_size", "target", "taken"]
    taken = Counter((r["doc_id"], r["text"], r["source"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in got.collect())
    assert taken == Counter(r for r in plain_mix(rows) if r[-1])


def test_mix_ranges(spark, monkeypatch):
    """Junk documents, whose keys are ten times larger, are cut into ranges as evenly as others."""
    rows = [(i, ("# " if i % 2 else "w ") * (3 + i % 5), "en", f"s{i % 2}", 9) for i in range(3000)]
    docs = spread(spark, rows)
    keyed = docs.select("source", mixing.draw_key(F.col("doc_id"), F.col("text"), mixing.quality(F.col("text"))).alias("key"))
    most = keyed.withColumn("part", mixing.range_of(keyed)).groupBy("part").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    assert most <= 3000 / mixing.QUANTILES
    assert Counter((r["doc_id"], r["taken"]) for r in mixing.mix(spark, docs).collect()) == Counter((r[0], r[-1]) for r in plain_mix(rows))


def test_tables_of_others_stay(spark, rows):
    """A stage removes what the stage before it wrote, not what other operators' results still read."""
    import corpus_pipeline

    docs = spread(spark, rows)
    waiting = minhash.near_duplicates(spark, docs)
    with Workspace.collected() as spaces:
        minhash.near_duplicates(spark, docs)
    assert len(spaces) == 1
    out = docs
    for _, stage in corpus_pipeline.STAGES[1:4]:
        out = spark.createDataFrame(stage(spark, out, SF).collect() or [], docs.schema)
    assert waiting.count() == len(rows)


def test_long_runs(spark):
    encoder = token_counts.Encoder(token_counts.load_ranks(token_counts.VOCABULARY))
    for c in " \n\ta":
        t = c * 1_000_000
        assert encoder.ends(t)[-1] == 1_000_000 and encoder.ends(t + "end")[-1] == 1_000_003
    pick = random.Random(1)
    for k in range(60):
        blank = "".join(pick.choice(" \n\t\xa0") for _ in range(1500)) if k % 2 else pick.choice(" \n") * 1200
        t = pick.choice(["", "ab", "x. "]) + blank + pick.choice(["", "word", "!", "1", "\x1c"])
        assert encoder.encode(t) == encoder.encoding.encode_ordinary(t)
    rows = token_counts.count_sections(spark, spark.createDataFrame([(1, " " * 1_000_000 + "\nx")], "doc_id long, text string")).collect()
    assert sorted((r["section"], r["n_bytes"]) for r in rows) == [(0, 1_000_001), (1, 1)]


def test_token_rules(spark):
    """Counts of every section under all four rules, by the tokens' byte spans."""
    texts = ["é\nÉé\n\nüß x", "naïve\n\n\n  café\n", "a\n\n b\n\n\n", "日本語\n日本\n", " \n \n x", ""]
    encoder = token_counts.Encoder(token_counts.load_ranks(token_counts.VOCABULARY))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    crossed = 0
    for rule in token_counts.RULES:
        got = {(r["doc_id"], r["section"]): (r["n_tokens"], r["n_crossing"]) for r in token_counts.count_sections(spark, docs, rule=rule).collect()}
        for d, t in enumerate(texts):
            raw, sections, at = t.encode(), [], 0
            for line in t.split("\n")[:-1]:
                sections.append((at, at + len(line.encode()) + 1))
                at = sections[-1][1]
            sections.append((at, len(raw)))
            expected, start = defaultdict(float), 0
            touched = Counter()
            for n in (len(encoder.encoding.decode_single_token_bytes(x)) for x in encoder.encoding.encode_ordinary(t)):
                parts = {k: min(b, start + n) - max(a, start) for k, (a, b) in enumerate(sections) if min(b, start + n) > max(a, start)}
                if len(parts) > 1:
                    touched.update(parts)
                if rule == "share":
                    for k, v in parts.items():
                        expected[k] += v / n
                else:
                    expected[{"start": min(parts), "end": max(parts), "most": min(parts, key=lambda k: (-parts[k], k))}[rule]] += 1
                start += n
            for k in range(len(sections)):
                assert abs(got[d, k][0] - expected[k]) < 1e-9 and got[d, k][1] == touched[k], (rule, t, k)
            crossed += sum(touched.values())
    assert crossed


@pytest.mark.parametrize("page", ["<div>" * 200_000, "<p>x" * 250_000, '<a "' * 250_000, '<a ="' * 200_000 + ">", "<![CDATA[" * 110_000, "<!" * 500_000, "<a ='>" * 160_000, "<b>x" * 250_000])
def test_hostile_pages(page):
    """1 MB of unclosed markup takes time in proportion: twice as much of it about twice as long."""
    def seconds(p):
        began = time.process_time()
        html_wrapper.main_text(p, None)
        html_wrapper.fold(html_wrapper.page_nodes(p))
        return time.process_time() - began

    half = max(seconds(page[: len(page) // 2]), 0.05)
    assert seconds(page) < 5 * half


def test_deep_text_stays():
    page = "<body>" + "".join(f"<div class=d{i}>t{i} " for i in range(500)) + "</body>"
    assert html_wrapper.main_text(page, None) == "\n".join(f"t{i}" for i in range(500))


def test_article_parts():
    """An article's own header and footer, and elements with other names than the parts named, are main text."""
    page = (
        "<body><header>Site</header><article><header><h1>Title</h1></header><p>One</p><div class='related-work'>Two</div><p class='search-results'>x</p>"
        "<figure class='banner'>Three</figure><div class='promo'>Four</div><footer>Five</footer><footer class='comments'>No</footer><aside>No</aside></article><footer>Foot</footer></body>"
    )
    assert html_wrapper.main_text(page, None) == "Title\nOne\nTwo\nThree\nFour\nFive"


def test_pages_without_article(spark, monkeypatch):
    """Hosts whose pages have no article are decided by their wrappers, however many rounds joining takes."""
    layouts = ["<body><div class=top>Daily News</div><div class=s{0}><h2>{1}</h2><p>{1} says a lot more</p></div><div class=end>All rights kept</div></body>"]
    rows = [(i, f"http://h{i % 3}.example/{i}", layouts[0].format(i % 40, f"story {i}")) for i in range(240)]
    docs = spread(spark, rows, "page_id long, url string, html string", 6)
    out = html_wrapper.extract(spark, docs)
    got = {r["page_id"]: r["text"] for r in out.collect()}
    assert got == {i: f"story {i}\nstory {i} says a lot more" for i in range(240)}
    assert {(r["by_wrapper"], r["pages"]) for r in html_wrapper.decided_by(out).collect()} == {(True, 240)}
    monkeypatch.setattr(html_wrapper.wrappers, "__defaults__", (4,))
    assert {r["page_id"]: r["text"] for r in html_wrapper.extract(spark, docs).collect()} == got


def test_long_streams_align(monkeypatch):
    """Unique tokens divide streams that are too long to compare in full; the pieces tile both."""
    monkeypatch.setattr(html_wrapper, "MOST_CELLS", 50)
    pick = random.Random(2)
    for _ in range(50):
        a = [pick.choice("xyz") if pick.random() < 0.6 else f"u{i}" for i in range(pick.randint(0, 60))]
        b = [s for s in a if pick.random() < 0.8]
        b[len(b) // 2 : len(b) // 2] = ["new"] * pick.randint(0, 4)
        ops = html_wrapper.opcodes(a, b)
        assert [x for op, i, j, _, _ in ops for x in a[i:j]] == a and [x for op, _, _, i, j in ops for x in b[i:j]] == b
        assert all(a[i:j] == b[k:m] for op, i, j, k, m in ops if op == "equal")
    assert ("equal", 0, 2, 0, 2) in html_wrapper.opcodes(["p", "q", *"xyxy" * 9], ["p", "q", *"zz" * 9])


def test_multi_index():
    """All items within the radius are found, a fifth or so of all is looked at, and similar texts are within it."""
    pick, hashes = random.Random(3), WordHashes()
    prints = np.array([pick.getrandbits(64) for _ in range(2000)], np.uint64)
    index = decontaminate.MultiIndex(prints)
    shares = []
    for _ in range(200):
        fp = int(prints[pick.randrange(2000)])
        for bit in pick.sample(range(64), pick.randint(0, 18)):
            fp ^= 1 << bit
        exact = [(i, d) for i, p in enumerate(prints.tolist()) if (d := (p ^ fp).bit_count()) <= decontaminate.RADIUS]
        assert sorted(index.near(fp)) == exact
        shares.append(len(index.candidates(fp)) / 2000)
    assert np.mean(shares) < 0.25
    found = tried = 0
    for k in range(400):
        w = [f"w{pick.randrange(20_000)}" for _ in range(60)]
        bags = [sequence_hashes(hashes.of(" ".join(x)), 5) for x in (w, w[:-6] + ["new"] * 6)]
        common, union = decontaminate.weighted_similarity(*(Counter(b.tolist()) for b in bags))
        if 0.8 <= common / union:
            a, b = (int(decontaminate.fingerprint(decontaminate.signs(x).sum(0)[None])[0]) for x in bags)
            tried, found = tried + 1, found + ((a ^ b).bit_count() <= decontaminate.RADIUS)
    assert tried > 100 and found >= 0.98 * tried


def test_short_items(spark):
    docs = spark.createDataFrame([(1, "to be or not"), (2, "not two words here"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "two words")], "item_id long, text string")
    assert [r["doc_id"] for r in decontaminate.find_leaks(spark, docs, bench).collect()] == [2]
    assert decontaminate.find_leaks(spark, docs, bench, min_words=3).count() == 0
    assert sorted(r["doc_id"] for r in decontaminate.drop_leaks(spark, docs, bench).collect()) == [1, 3]


def test_field_gradient():
    """The gradient is that of the weighted log-likelihood, whose partition sums are enumerated."""
    pick = np.random.default_rng(4)
    lengths, labels = np.array([3, 1, 4]), np.array([1, 0, 0])
    x, theta = pick.normal(size=(8, 5)), pick.normal(size=9) * 0.5

    def likelihood(theta):
        weights, moves, out, at = theta[:-4], theta[-4:].reshape(2, 2), 0.0, 0
        for n, label in zip(lengths, labels, strict=True):
            s = x[at : at + n] @ weights
            value = lambda y: sum(s[t] * y[t] for t in range(n)) + sum(moves[y[t], y[t + 1]] for t in range(n - 1))  # noqa: B023, E731
            total = np.log(sum(np.exp(value(y)) for y in itertools.product((0, 1), repeat=int(n))))
            out += (value([label] * n) - total) / n
            at += n
        return out / len(lengths) - line_crf.SHRINK / 2 * (theta**2).sum()

    step = 1e-6 * np.eye(9)
    numeric = np.array([(likelihood(theta + d) - likelihood(theta - d)) / 2e-6 for d in step])
    assert np.allclose(line_crf.gradient(theta, x, lengths, labels), numeric, atol=1e-7)


def test_fit_bounds(spark):
    """Whole texts up to the bounds, one text an id; what comes after the bound plays no part."""
    docs = spread(spark, [(i, "good line here\n" * 3, None, None, 0) for i in range(40)] + [(i, "good line here\n" * 3, None, None, 0) for i in range(40)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    seen = []
    fit = line_crf.fit
    try:
        line_crf.fit = lambda sequences, y: seen.append((len(sequences), {len(s) for s in sequences})) or fit(sequences, y)
        line_crf.train(spark, docs, labels)
        line_crf.train(spark, docs, labels, fit_docs=7)
        line_crf.train(spark, docs, labels, fit_lines=9)
    finally:
        line_crf.fit = fit
    assert 20 < seen[0][0] < 40 and seen[1:] == [(7, {4}), (3, {4})] and seen[0][1] == {4}


def plain_list(rows, cuts, learner):
    """Sequential covering over lists of (features, bad, part)."""
    import math

    def holds(c, f):
        return f[c.feature] > c.threshold if c.above else f[c.feature] <= c.threshold

    rules, left = [], list(rows)
    while len(rules) < learner.max_rules:
        grow, rule = [r for r in left if r[2] == "grow"], []
        while len(rule) < learner.max_conditions:
            bad = sum(r[1] for r in grow)
            good = len(grow) - bad
            if bad < learner.min_covered or not good:
                break
            best = None
            for f in quality_rules.FEATURES:
                for t in cuts[f]:
                    for above in (False, True):
                        c = quality_rules.Condition(f, above, float(t))
                        inside = [r for r in grow if holds(c, r[0])]
                        y = sum(r[1] for r in inside)
                        if y >= learner.min_covered:
                            gain = y * (math.log2(y / len(inside)) - math.log2(bad / (bad + good)))
                            if gain > 1e-9 and (best is None or gain > best[0]):
                                best = (gain, c)
            if best is None:
                break
            rule.append(best[1])
            grow = [r for r in grow if holds(best[1], r[0])]
        prune, scores = [r for r in left if r[2] == "prune"], []
        for k in range(len(rule)):
            inside = [r for r in prune if all(holds(c, r[0]) for c in rule[: k + 1])]
            if sum(r[1] for r in inside) >= 2:
                scores.append((sum(r[1] for r in inside) / len(inside), -k))
        if not scores or max(scores)[0] < learner.min_precision:
            break
        rule = rule[: 1 - max(scores)[1]]
        rules.append(rule)
        left = [r for r in left if not all(holds(c, r[0]) for c in rule)]
    return rules


def test_rules_are_learned(spark):
    """Two planted rules are found, as a plain version finds them, and hold on rows kept out of learning."""
    pick = random.Random(6)
    made = []
    for i in range(1500):
        f = {"symbol_share": pick.random() / 10, "repeat_share": pick.random() / 2, "dup_line_share": pick.random(), "mean_word": 3 + 4 * pick.random(), "log_words": 4 + 5 * pick.random()}
        bad = f["symbol_share"] > 0.07 or (f["mean_word"] > 6 and f["dup_line_share"] > 0.6)
        made.append((f, int(bad), ("grow", "grow", "prune", "held")[pick.randrange(4)]))
    rows = spark.createDataFrame([(*f.values(), b, p) for f, b, p in made if p != "held"], ", ".join(f"{k} double" for k in made[0][0]) + ", bad int, part string").cache()
    learner = quality_rules.Learner()
    cuts, fit_cuts = {}, learner._grow
    learner._grow = lambda left, c: cuts.update(c) or fit_cuts(left, c)
    found = learner.fit(rows)
    assert [list(map(str, r)) for r in found.rules] == [list(map(str, r)) for r in plain_list([r for r in made if r[2] != "held"], cuts, learner)]
    assert len(found.rules) >= 2
    held = spark.createDataFrame([(*f.values(), b) for f, b, p in made if p == "held"], ", ".join(f"{k} double" for k in made[0][0]) + ", bad int")
    n = {(x["stays"], x["bad"]): x["count"] for x in held.withColumn("stays", found.verdict()).groupBy("stays", "bad").count().collect()}
    assert n[False, 1] >= 0.95 * (n[False, 1] + n.get((False, 0), 0)) and n[False, 1] >= 0.8 * (n[False, 1] + n.get((True, 1), 0))


SECRETS = {
    "private": "-----BEGIN RSA PRIVATE KEY-----", "github": "ghp_" + "aB3" * 12, "slack": "xoxb-" + "12-ab" * 4, "jwt": "eyJ" + "a" * 10 + ".eyJ" + "b" * 10 + "." + "c" * 10,
    "google": "AIza" + "x_-9Z" * 7, "live": "sk_live_" + "q7" * 10,
}


def test_extra_secrets(spark):
    texts = [f"before {v} after" for v in SECRETS.values()] + [v[:-12] for v in SECRETS.values()]
    rows = {r["doc_id"]: r["spans"] for r in secret_scan.scan_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for k, (kind, v) in enumerate(SECRETS.items()):
        assert f"{kind}:7:{7 + len(v)}" in rows[k].split(","), kind
        assert f"{kind}:" not in rows[len(SECRETS) + k]


def test_trigram_queries():
    """A query never misses a text that its expression matches; expressions without a trigram scan everything."""
    rule = lambda p, fold=False: secret_scan.Rule("r", p, fold=fold)
    assert secret_scan.trigram_query(rule("[0-9a-f]+")) == [] and secret_scan.trigram_query(rule("ab")) == []
    assert secret_scan.trigram_query(rule("abcd")) == [[{"abc", "bcd"}]] and secret_scan.trigram_query(rule("xa?b.c")) == []
    assert secret_scan.trigram_query(rule("xa?bc")) == [[{"xab", "abc"}, {"xbc"}]] or secret_scan.trigram_query(rule("xa?bc")) == [[{"xbc"}, {"xab", "abc"}]]
    pick = random.Random(7)
    for pattern in ("abc|bcd", "a(bc)?d", "(ab|ba)c+d", "ab[cd]a", "a.bcd", "(abc){2}", "ab*c"):
        scanner = secret_scan.Scanner([rule(pattern)])
        texts = ["".join(pick.choice("abcd") for _ in range(pick.randint(0, 9))) for _ in range(400)]
        found = scanner.scan(texts)
        assert [[(s, e) for s, _, _, e in x] for x in found] == [[m.span() for m in re.finditer(pattern, t)] for t in texts]


def test_stages_against_plain_versions(spark, rows):
    """Each stage on rows that repeat, with null ids, in the order of the pipeline."""
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    common = "A line of more than forty code points that many have"
    base = [(i, f"{common}\n{text(f'd{i}x', 60)}", "en", ("x", "y")[i % 2], 1) for i in range(12)]
    bench = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len(words(r["text"])) >= 20]
    base += [base[0], base[0], (None, base[1][1], None, None, None), (3, f"{common}\nnot so long", "de", "x", 2), (20, None, None, None, None), (21, f"{text('q', 60)} {bench[0]} {text('z', 9)}", "en", "x", 1)]
    docs = spread(spark, base, n=5).withColumn("kept_text", F.lit("own")).withColumn("_doc", F.lit(1))
    take = lambda df: Counter((r["doc_id"], r["text"], r["lang"], r["source"]) for r in df.collect())

    def write(df):
        assert df.columns == docs.columns
        return spark.createDataFrame(df.collect(), df.schema).repartition(3)

    now = write(stages["quality"](spark, docs, SF))
    labels = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    judged, _ = quality_rules.judge(spark, docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert labels and take(now) == Counter({k: n for k, n in take(docs).items() if len(words(k[1])) >= 50}) and judged.count() == len(base)
    holders = {r["doc_id"] for r in now.collect() if r["doc_id"] is not None and common in r["text"]}
    assert len(holders) >= 5
    expected = Counter()
    for (i, t, lang, source), n in take(now).items():
        keep = [x for x in t.split("\n") if x != common or i is None or i == max(holders)]
        expected[i, "\n".join(keep), lang, source] += n
    now = write(stages["lines"](spark, now, SF))
    assert take(now) == expected and all(r["n_chars"] == len(r["text"]) for r in now.collect() if common not in r["text"] and "q0" not in r["text"])
    before = [tuple(r) for r in now.collect()]
    groups, _ = plain_near(before)
    now = write(stages["near"](spark, now, SF))
    assert now.count() == len(groups)
    before = take(now)
    leaked = bench[0]
    now = write(stages["leaks"](spark, now, SF))
    assert take(now) == Counter({k: n for k, n in before.items() if leaked not in k[1]}) and sum(before.values()) > now.count()
    out = stages["mix"](spark, now, SF)
    expected = Counter((r[0], r[1], r[2], r[-1]) for r in plain_mix([tuple(r)[:5] for r in now.collect()]) if r[-1])
    assert Counter((r["doc_id"], r["text"], r["source"], r["taken"]) for r in out.collect()) == expected
    for f in stages.values():
        assert f(spark, docs.limit(0), SF).count() == 0
