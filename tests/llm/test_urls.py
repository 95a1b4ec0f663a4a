from bitdex.llm import urls

SCHEMA = "page_id long, url string, html string, host string, word string"


def run(spark, found):
    df = spark.createDataFrame([(i, u, h, "clash", "clash") for i, (u, h) in enumerate(found)], SCHEMA)
    return [r for r in sorted(urls.verdicts(df).collect(), key=lambda r: r.page_id)]


def test_parts_and_rules(spark):
    cases = {
        "http://A.Example.COM/en/1?q=://x": ("a.example.com", "/en/1", "example.com/en/", "block"),
        "http://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        "http://x.www.example.com/en/z#f": ("x.www.example.com", "/en/z", "www.example.com/en/", "allow"),
        "https://b.com/": ("b.com", "/", "com/", "allow"),
        "https://b.net/es/1": ("b.net", "/es/1", "net/es/", "block"),
        "https://net/fr/": ("net", "/fr/", "net/fr/", "block"),
        "https://bnet/fr/": ("bnet", "/fr/", None, "allow"),
        "https://b.com": ("b.com", "", None, "allow"),
        "https://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
        "x://?a": ("", "", None, "allow"), "no scheme": ("", "", None, "allow"), "": ("", "", None, "allow"),
        None: ("", "", None, "allow"), "a://B/c#d://e": ("b", "/c", None, "allow"),
    }
    got = run(spark, [(u, None) for u in cases])
    assert [(r.host, r.path, r.rule, r.verdict) for r in got] == list(cases.values())


def test_viterbi():
    counts = {"cheap": 50, "pills": 30, "the": 800, "ill": 20, "spam": 9, "farm": 9}

    def cut(label):
        pieces = [(i, n, counts[label[i:i + n]]) for i in range(len(label)) for n in range(1, len(label) + 1 - i)
                  if counts.get(label[i:i + n])]
        return urls.viterbi(label, pieces, 2301.0)
    assert cut("cheappills") == ["cheap", "pills"]
    assert cut("spamfarm") == ["spam", "farm"]
    assert cut("zzz") == ["zzz"]
    assert cut("thexqzk") == ["the", "xqzk"]
    assert cut("xthey") == ["xthey"]                  # a known word inside doesn't break an unknown name
    assert urls.viterbi("", [], 10.0) == []


def test_viterbi_against_all_cuts():
    import itertools
    import math
    import random
    rnd = random.Random(0)
    for _ in range(200):
        label = "".join(rnd.choices("ab", k=rnd.randrange(1, 9)))
        counts = {"".join(rnd.choices("ab", k=rnd.randrange(1, 4))): rnd.randrange(1, 50) for _ in range(4)}
        total = 300.0

        def cost(words):
            return sum(math.log(total / counts[w]) if w in counts and k else math.log(total) + urls.LETTER * len(w)
                       for w, k in words)
        cuts = []
        for marks in itertools.product([0, 1], repeat=len(label) - 1):
            at = [0, *[i + 1 for i, m in enumerate(marks) if m], len(label)]
            words = [label[x:y] for x, y in zip(at, at[1:])]
            cuts.append(cost([(w, True) for w in words]))
        pieces = [(i, n, counts[label[i:i + n]]) for i in range(len(label)) for n in range(1, len(label) + 1 - i)
                  if label[i:i + n] in counts]
        got = urls.viterbi(label, pieces, total)
        assert "".join(got) == label
        assert cost([(w, True) for w in got]) <= min(cuts) + 1e-9


def test_segmented_names_are_judged(spark):
    title = "<title>cheap pills and blue garden news for the town</title>"
    found = [("http://a.example.org/x", title)] * 20 + [
        ("http://cheappills.example.org/de/9", None), ("http://bluegarden.example.org/de/9", None)]
    got = run(spark, found)
    assert got[20].host_words.split()[:2] == ["cheap", "pills"] and got[20].verdict == "block"
    assert got[21].host_words.split()[:2] == ["blue", "garden"] and got[21].verdict == "allow"


def test_empty_and_long(spark):
    assert run(spark, [("http://" + "ab" * 2000 + ".org/" + "p" * 3000, "")] * 2)[1].verdict == "allow"
    df = spark.createDataFrame([], SCHEMA)
    assert urls.verdicts(df).collect() == []


SPAM = {"cheap-pills": "cheap pills", "free-bets": "free bets", "adult-x": "adult x", "casino-win": "casino win",
        "spam-farm": "spam farm", "ads-track": "ads track"}


def test_pages_table(spark, sf001):
    """Spam families are blocked where no rule decides, and nothing else is."""
    for sf in (sf001, sf001.replace("0.001", "0.01")):
        rows = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
        got = urls.op5_url_filter(spark, sf).collect()
        assert {r.page_id for r in got} == set(rows) and len(got) == len(rows)
        assert all(rows[r.page_id].split("://")[1].startswith(r.host + r.path) for r in got)
        free = [r for r in got if r.rule is None]
        assert {r.page_id for r in free if r.verdict == "block"} == {
            r.page_id for r in free if any(f in r.host for f in SPAM)}
        for r in got:
            for family, words in SPAM.items():
                if family in r.host:
                    assert words in r.host_words
    assert any(r.verdict == "block" for r in free)


def test_odds_against_brute_force(spark, sf001):
    """Hosts that rules decide whole, the words of their hosts and paths, and the listed words."""
    import math
    import re
    from collections import defaultdict
    got = urls.op5_url_filter(spark, sf001).collect()
    cut = {r.host: r.host_words.split() for r in got}
    by_host = defaultdict(set)
    paths = defaultdict(set)
    for r in got:
        by_host[r.host].add(r.verdict if r.rule else None)
        paths[r.host].update(w for w in re.findall(r"[^\W\d_]+", r.path.lower()))
    block, allow = defaultdict(float), defaultdict(float)
    for w in urls.BAD:
        block[w] += urls.PRIOR
    for w in urls.GOOD:
        allow[w] += urls.PRIOR
    for host, said in by_host.items():
        if len(said) == 1 and None not in said and host:
            for w in {*cut[host], *paths[host]}:
                if len(w) >= urls.SHORTEST:
                    (block if said == {"block"} else allow)[w] += 1
    b, a = sum(block.values()), sum(allow.values())
    share = b / (a + b)
    named = {w for h, p, _ in urls.RULES for w in (h + p).replace("/", ".").split(".")}

    def odds(w):
        if w in named or w not in block and w not in allow:
            return 0.0
        return math.log((block[w] + urls.SMOOTH * share) / (allow[w] + urls.SMOOTH * (1 - share))) - math.log(share / (1 - share))
    for r in got:       # paths of these pages hold no word that could be cut
        want = sum(map(odds, cut[r.host])) + sum(map(odds, re.findall(r"[^\W\d_]+", r.path.lower())))
        assert abs(r.score - want) < 1e-6


def test_long_words_of_the_model(spark):
    """A word of any length is one."""
    long = "donaudampfschifffahrtsgesellschaft"
    got = run(spark, [("http://a.example.org/x", f"<p>{long} {long} garden garden</p>")] * 5 + [
        (f"http://{long}garden.example.org/de/9", None)])
    assert got[5].host_words.split()[:2] == [long, "garden"]


def test_text_words():
    html = "<title>Big News</title><style>p{}</style><SCRIPT>var x='no';</script ><p>a.b@c see http://x.y/z &amp; Ärger. End.<br>ok"
    assert urls.text_words(html) == ["big", "news", "see", "ärger", "end", "ok"]


def test_hot_hosts_are_cut(spark):
    """A label stays no word however many pages stand on its host, name it or give its address."""
    title = "<title>cheap pills and blue garden news for the town</title>"
    own = "<title>CheapPills</title><style>cheappills{}</style><p>cheappills at home"
    found = [("http://a.example.org/x", title)] * 100 + [("http://cheappills.example.org/de/9", own)] * 300 + [
        ("http://bluegarden.example.org/de/9", "<p>see http://cheappills.example.org and cheappills.example.org")] * 300
    got = run(spark, found)
    assert {(r.host_words, r.verdict) for r in got[100:400]} == {("cheap pills example org", "block")}
    assert {(r.host_words, r.verdict) for r in got[400:]} == {("blue garden example org", "allow")}
