from tarn.llm import url_filter as U


def brute(url):
    """host, path, rule, the rule's verdict."""
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        rest = rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])] if rest[:1] == "/" else ""
    best = None
    for rule, allow in (("net/", False), ("example.net/en/", True), ("example.com/de/", False), ("org/fr/", True)):
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = rule, allow
    return host, path, best and best[0], best and ("allow" if best[1] else "block")


ODD = ["http://A.Example.NET/en/1?x#y", "https://example.net/en", "https://net/", "http://fishnet/x", "http://b.net?x=1", "http://c.org/fr/2", "http://c.org/FR/2", "http://example.com/de/", "ftp://x.example.com#de/", "no scheme", "", None, "http://", "a://b://c.net/", "http://É.example.net/en/", "http://x.example.com/en/\n9", "http://y.net/\nz"]


def pages(spark, n=400):
    hosts = ["news.example.com", "blog.words.example.org", "m.letters.example.net", "casinopoker.example.com", "spam-phishing.example.org"]
    rows = [(i, f"http://{hosts[i % 5]}/{('en', 'de', 'fr', 'es')[i % 4]}/{i}") for i in range(n)] + [(1000 + i, u) for i, u in enumerate(ODD)] + [(1000, ODD[0]), (None, ODD[1])]
    return rows, spark.createDataFrame([(i, u, "x", "y") for i, u in rows], "page_id long, url string, host string, verdict string")


def test_hosts_paths_and_rules(spark):
    rows, df = pages(spark)
    got = U.judge_urls(df).collect()
    assert len(got) == len(rows)
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.page_id, r.host, r.path, r.rule) for r in got), key=key) == sorted(((i, *brute(u)[:3]) for i, u in rows), key=key)
    by_rule = {i: brute(u)[3] for i, u in rows if i is not None}
    for r in got:
        assert r.verdict in ("allow", "block")
        if r.rule:
            assert r.verdict == by_rule.get(r.page_id, r.verdict)
        elif r.host.startswith(("casino", "spam")):
            assert r.verdict == "block"
        elif r.host.startswith(("news", "blog")):
            assert r.verdict == "allow"


def test_chances_by_brute_force(spark):
    """Witten-Bell chances against a plain recursion."""
    from collections import Counter
    from math import isclose, log

    urls = [("abracadabra", 1), ("abrasive", 1), ("cabal", 0), ("dab", 0)]
    df = spark.createDataFrame(urls, "url string, label int").withColumn("text", U.normal(U.F.col("url"), "host"))
    counted = U.grams(df).groupBy("gram", "label").agg(U.F.count("*").alias("n"))
    got = {r.gram: r.ratio for r in U.log_ratios(counted, counted).collect()}
    counts = {c: Counter() for c in (0, 1)}
    for r in counted.collect():
        for k in range(U.ORDER + 1):
            counts[r.label][r.gram[U.ORDER - k :]] += r.n

    def chance(c, gram):
        if gram == "":
            return 1 / U.ALPHABET
        k = len(gram)
        below = chance(c, gram[1:])
        around = {g: n for g, n in counts[c].items() if len(g) == k and g[:-1] == gram[:-1]}
        return (around.get(gram, 0) + len(around) * below) / (sum(around.values()) + len(around)) if around else below

    for gram, ratio in got.items():
        assert isclose(ratio, log(chance(1, gram)) - log(chance(0, gram)), abs_tol=1e-9)


def test_empty(spark):
    assert U.judge_urls(pages(spark)[1].limit(0)).count() == 0


def chances(counts, c, gram):
    """Witten-Bell chance of the last character of gram under model c; counts[c][k] holds grams of k characters."""
    p = 1 / U.ALPHABET
    for k in range(1, U.ORDER + 2):
        tail = gram[len(gram) - k :]
        total, kinds = counts[c]["around"].get(tail[:-1], (0, 0))
        if kinds:
            p = (counts[c]["seen"].get(tail, 0) + kinds * p) / (total + kinds)
    return p


def fitted(weighed):
    """Counts of both models from (text, label, weight)."""
    counts = {c: {"seen": {}, "around": {}} for c in (0, 1)}
    for text, label, n in weighed:
        for i in range(U.ORDER, len(text)):
            for k in range(1, U.ORDER + 2):
                tail = text[i + 1 - k : i + 1]
                counts[label]["seen"][tail] = counts[label]["seen"].get(tail, 0) + n
    for c in (0, 1):
        for tail, n in counts[c]["seen"].items():
            total, kinds = counts[c]["around"].get(tail[:-1], (0, 0))
            counts[c]["around"][tail[:-1]] = total + n, kinds + 1
    return counts


def mean_ratio(counts, texts):
    from math import log

    each = [log(chances(counts, 1, t[i - U.ORDER : i + 1])) - log(chances(counts, 0, t[i - U.ORDER : i + 1])) for t in texts for i in range(U.ORDER, len(t))]
    return sum(each) / (len(each) + U.SHORTEST)


def split(url):
    """(part, text) of the names and steps that are not empty."""
    plain = lambda t: "".join("0" if c.isdecimal() else c for c in t.lower())
    rest = url.split("://", 1)[1] if "://" in url else url
    host = rest[: min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])] if "://" in url else ""
    return [(p, U.STARTS[p] * U.ORDER + plain(t)) for p, some in (("host", host.split(".")[:-1] or [host]), ("path", rest[len(host) :].split("/"))) for t in some if t]


def lowest(counts, parts):
    out = {}
    for p, t in parts:
        out[p] = min(out.get(p, 99), mean_ratio(counts, [t]))
    return out


def brute_judged(spark, rows):
    """(ratios by URL and part, thresholds by part) by plain counting, a URL at a time."""
    from collections import Counter

    times = Counter(u for _, u in rows if u is not None)
    label = {u: {"allow": 1, "block": 0, None: None}[brute(u)[3]] for u in times}
    of_host = Counter()
    for u, n in times.items():
        of_host[brute(u)[0], label[u]] += n
    every = [(brute(u)[0], split(u), label[u], n / of_host[brute(u)[0], label[u]] * U.HOST_WEIGHT) for u, n in times.items()]
    every += [(name, split(u), c, 1.0) for u, c, name in U.SEEDS]
    names = sorted({e[0] for e in every})
    folds = dict(spark.createDataFrame([(n,) for n in names], "name string").select("name", U.fold(U.F.col("name"))).collect())
    spread = lambda some: [(t, c, n) for _, parts, label, n in some for _, t in parts for c in ((0, 1) if label is None else (label,))]
    final = fitted(spread(every))
    kept = [fitted(spread(e for e in every if e[2] is None or folds[e[0]] != k)) for k in range(U.FOLDS)]
    held = {}
    for name, parts, c, _ in every:
        for p, t in parts if c == 1 else ():
            held.setdefault(p, {}).setdefault(name, []).append(t)
    low = {}
    for p, of in held.items():
        ratios = sorted(min(mean_ratio(kept[folds[name]], [t]) for t in set(texts)) for name, texts in of.items())
        k = max(0, -(-int(U.FALSE_BLOCKS[p] * len(ratios) * 1e9) // 10**9) - 1)
        low[p] = ratios[max(0, k - 1) : k + 2]  # the quantile is exact to a rank
    return {u: lowest(final, split(u)) for u in times}, low


def test_ratios_and_verdicts_by_brute_force(spark, monkeypatch):
    rows, df = pages(spark, 120)
    want, low = brute_judged(spark, rows)
    for most in (U.BROADCAST_ROWS, 50):
        monkeypatch.setattr(U, "BROADCAST_ROWS", most)
        url = {i: u for i, u in rows if i is not None}
        for r in U.judge_urls(df).where("page_id <> 1000").collect():
            u = url[r.page_id]
            mine = want.get(u, {})
            at = {"host": r.host_threshold, "path": r.path_threshold}
            assert all(min(abs(at[p] - x) for x in low[p]) < 1e-9 for p in at)
            assert abs(r.host_ratio - mine.get("host", 0.0)) < 1e-9 and abs(r.path_ratio - mine.get("path", 0.0)) < 1e-9
            rule = brute(u)[3]
            assert r.verdict == (rule or ("allow" if u and all(x >= at[p] - 1e-9 for p, x in mine.items()) else "block"))


def test_one_verdict_for_the_urls_of_a_host(spark):
    """A seed word as a name of the host blocks all its URLs, hosts of no known word have none blocked; a seed word inside
    a longer name lowers the ratio, if not always below the threshold."""
    named, inside = ["casino", "www.poker", "viagra"], ["mycasinopalace", "bestpokerroom", "pornhaven", "viagraworld", "allwarez"]
    wanted = ["brantholm", "oakridge", "marlowharbour", "finchbury", "stonewell", "citylibrary", "gardenweek", "weatherdesk"]
    hosts = named + inside + wanted
    rows = [(i, f"https://{hosts[i % len(hosts)]}.example.com/{('a', 'b/c', '')[i % 3]}?p={i % 7}") for i in range(480)]
    found = {}
    for r in U.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect():
        found.setdefault(r.host.removesuffix(".example.com"), set()).add((r.verdict, r.host_ratio))
    assert all(len(found[h]) == 1 for h in hosts)
    found = {h: next(iter(v)) for h, v in found.items()}
    assert all(found[h][0] == "block" for h in named) and all(found[h][0] == "allow" for h in wanted)
    assert max(found[h][1] for h in inside) < min(found[h][1] for h in wanted)


def test_errors_on_words_kept_out(spark):
    """Words that neither the models nor the thresholds have seen, in another URL shape, two folds of five: at most 5 % of the
    accepted ones are blocked. The rejected ones are hardly recognised: their letters are not those of other words."""
    blocked, total = {0: 0, 1: 0}, {0: 0, 1: 0}
    for k in (0, 3):
        names = sorted({n for _, _, n in U.SEEDS})[k::5]
        label = {n: c for _, c, n in U.SEEDS}
        rows = [(i, f"http://my{n}.example.com/view?id={i}") for i, n in enumerate(names)]
        seeds = tuple(s for s in U.SEEDS if s[2] not in names)
        for r in U.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), rules=(), seeds=seeds).collect():
            c = label[names[r.page_id]]
            total[c] += 1
            blocked[c] += r.verdict == "block"
    print("false blocks", blocked[1], "of", total[1], "false allows", total[0] - blocked[0], "of", total[0])
    assert blocked[1] <= 0.05 * total[1]


def test_grams_of_pieces(spark):
    texts = ["", "ab", "x" * 255 + "yz", "abcdefgé𝒳" * 200]
    df = spark.createDataFrame([(i, U.STARTS["host"] * U.ORDER + t) for i, t in enumerate(texts)], "i int, text string")
    got = sorted((r.i, r.gram) for r in U.grams(df).collect())
    assert got == sorted((i, (U.STARTS["host"] * U.ORDER + t)[k : k + U.ORDER + 1]) for i, t in enumerate(texts) for k in range(len(t)))


def test_very_long_url(spark):
    long_ = "http://news.example.com/en/" + "a-long-path/" * 30_000
    got = U.judge_urls(spark.createDataFrame([(1, long_), (2, "http://casino.example.com/en/1")], "page_id long, url string")).collect()
    assert {r.page_id: len(r.path) for r in got} == {1: len(long_) - len("http://news.example.com"), 2: 5}
