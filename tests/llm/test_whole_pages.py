"""Short articles on pages that are nearly all template, and copies beside them."""

from discoforge.llm import pages

MENU = [f"Menu line {i} of the site, the same on every page" for i in range(80)]


def page(*own):
    return "<html><body>" + "".join(f"<div>{x}</div>" for x in [*MENU[:40], *own, *MENU[40:]]) + "</body></html>"


def texts(spark, rows):
    return {r["page_id"]: r["text"] for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect()}


def test_short_articles_on_a_large_template(spark):
    own = {i: f"Tale {i}: " + " ".join(f"word{i}x{j}" for j in range(40)) for i in range(5)}
    assert all(len(x) < 0.1 * sum(map(len, MENU)) for x in own.values())
    got = pages.article(pages.blocks(page(own[0])), pages.blocks(page(own[1])))
    assert got == own[0]
    for n in (2, 5):
        rows = [(i, f"https://x.example/news/{i}", page(own[i])) for i in range(n)]
        assert texts(spark, rows) == {i: own[i] for i in range(n)}


def test_copies_keep_their_article(spark):
    tale, other = "A tale told twice, in the same words", "Another tale"
    copies = [(1, "https://x.example/a/1", page(tale)), (2, "https://x.example/a/2", page(tale))]
    assert all(x == "\n".join([*MENU[:40], tale, *MENU[40:]]) for x in texts(spark, copies).values())
    got = texts(spark, [*copies, (3, "https://x.example/b", page(other))])
    assert got == {1: tale, 2: tale, 3: other}
    near = [(1, "https://x.example/a/1", page(tale, "printed in May")), (2, "https://x.example/a/2", page(tale, "printed in June")), (3, "https://x.example/b", page(other))]
    assert texts(spark, near) == {1: tale + "\nprinted in May", 2: tale + "\nprinted in June", 3: other}


def declared(n, *tail, lead=("Latest offers",)):
    own = [f"Report {n}: " + " ".join(f"w{n}x{j}" for j in range(30)), f"It ends on day {n}"]
    lines = [*lead, *own, *tail]
    return own, "<html><body><nav>Home</nav><main>" + "".join(f"<p>{x}</p>" for x in lines) + "</main></body></html>"


def test_lines_of_the_site_within_a_declared_body_go(spark):
    tail = ["Sign up to our weekly letter", "Copyright"]
    made = [declared(n, *tail) for n in range(6)]
    rows = [(n, f"https://x.example/news/{n}", html) for n, (_, html) in enumerate(made)]
    assert texts(spark, rows) == {n: "\n".join(own) for n, (own, _) in enumerate(made)}
    alone = texts(spark, rows[:1])[0]  # without pages beside it nothing tells them apart
    assert alone.split("\n") == ["Latest offers", *made[0][0], *tail]


def test_passages_that_articles_share_stay(spark):
    quote = "A passage that many articles quote"
    rows = [(n, f"https://x.example/news/{n}", declared(n, *([quote, f"Source {n}"] if n % 2 else [f"Source {n}", quote]), lead=())[1]) for n in range(6)]
    assert all(quote in x.split("\n") for x in texts(spark, rows).values())
    one = [(n, f"https://x.example/news/{n}", declared(n, *([quote] if n < 2 else []), lead=())[1]) for n in range(6)]
    got = texts(spark, one)
    assert all(got[n].endswith(quote) for n in (0, 1))


def test_copies_of_a_declared_article_stay_whole(spark):
    body = declared(1, "Copyright")[1]
    rows = [(n, f"https://x.example/news/{n}", body) for n in range(4)] + [(9, "https://x.example/news/9", declared(2, "Copyright")[1])]
    got = texts(spark, rows)
    assert all("\n".join(declared(1)[0]) in got[n] for n in range(4))
