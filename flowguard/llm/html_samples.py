"""Small labelled pages, made up for this purpose: html and a sign for each text block (+ main text, - anything else)."""

_LONG = "The river had been high for a week before anyone in the village thought to move the boats up to the old mill."
_MID = "Nobody knew who had built the bridge."
_MORE = "By the second evening the water stood at the door of the inn, and the guests carried their bags upstairs while the cook went on as if nothing had happened."

LABELLED: list[tuple[str, str]] = [
    # a magazine page: menu, advert, article with short paragraphs, footer
    (
        f"""<html><head><title>Boats</title><script>var x = "<p>";</script></head><body>
        <nav><ul><li><a href="/a">Home</a></li><li><a href="/b">World</a></li><li><a href="/c">Sport</a></li></ul></nav>
        <div class="ad">Buy two boats, get one paddle for free this week.</div>
        <article><h1>High water</h1><p>{_LONG}</p><p>{_MID}</p><p>Then it rained.</p><p>{_MORE}</p><p>No.</p></article>
        <footer>&copy; 2020 The Village Paper &middot; All the news that floats.</footer></body></html>""",
        "---" + "-" + "++++++" + "-",
    ),
    # the same with open paragraphs and a break, a bare word list in the article and no end
    (
        f"""<html><body><nav><a href="/x">One</a> <a href="/y">Two</a></nav><div class="ad">{_MORE}</div>
        <article><h1>{_MID}</h1><p><b>{_LONG}<br><p>{_MID}<p>Rain<p>{_MORE}<br>Mud.</p><p>Stones, sand, reeds</p></article>
        <footer>{_LONG}</footer>""",
        "-" + "-" + "+++++++" + "-",
    ),
    # a blog: header, content by class name, comments, sidebar, newsletter form, cookie notice
    (
        f"""<body><div id="cookie-consent">We use cookies to make this site better. <a href="/ok">Accept</a></div>
        <header><a href="/">My blog</a><p>Notes on rivers and bridges</p></header>
        <div class="post-content"><h2>On bridges</h2><p>{_MORE}</p><p>{_MID}</p><blockquote>{_LONG}</blockquote><ul><li>Stone</li><li>Wood</li></ul><p>{_LONG} See <a href="/m">the mill</a>.</p></div>
        <div class="comments"><h3>2 comments</h3><div class="comment"><p>{_LONG}</p></div><div class="comment"><p>Nice!</p></div></div>
        <aside><h3>About me</h3><p>{_MID} I live by the river.</p></aside>
        <form><p>Get new posts by mail:</p><input name="m"></form>
        <footer><p>Powered by a water wheel</p></footer></body>""",
        "-" + "--" + "+++++++" + "---" + "--" + "-" + "-",
    ),
    # news: article with a header of its own, an advert and share links inside, related links
    (
        f"""<body><div class="topbar"><a href="/login">Log in</a> <a href="/sub">Subscribe now</a></div>
        <main><article><header><h1>Mill to reopen</h1><p>By a reporter in the valley</p></header><p>{_LONG}</p>
        <div class="advert">Waders at half the price, today only.</div><p>{_MORE}</p><div class="share"><a href="/s">Share</a> <a href="/t">Send</a></div>
        <p>{_MID}</p><h2>What comes next</h2><p>{_LONG}</p><section class="related"><h3>More on this</h3><ul><li><a href="/1">The flood of last year in pictures</a></li><li><a href="/2">Who owns the mill</a></li></ul></section></article>
        <section id="comments"><h2>Readers say</h2><p>{_MORE}</p><p>I was there.</p></section></main>
        <footer><ul><li><a href="/i">Imprint</a></li><li><a href="/p">Privacy</a></li></ul><p>{_MID}</p></footer></body>""",
        "-" + "+++" + "-" + "+" + "-" + "+++" + "---" + "---" + "---",
    ),
    # plain old page without names: text in divs and table cells between link lists
    (
        f"""<body><a href="1.html">Back</a> | <a href="2.html">Next</a> | <a href="3.html">Index</a><hr>
        <h1>The bridge book</h1><div>{_LONG} {_MORE}</div><div>{_MORE} {_LONG}</div><p>{_LONG}</p><hr>
        <a href="1.html">Back</a> | <a href="2.html">Next</a><br><i>Last changed in May</i></body>""",
        "-" + "+" + "+++" + "--",
    ),
    # documentation: breadcrumbs, menu, code, list
    (
        f"""<body><div class="breadcrumb"><a href="/d">Docs</a> &gt; <a href="/d/e">Engines</a></div>
        <div class="sidebar"><p><a href="/1">Start</a></p><p><a href="/2">Stop</a></p><p>Version 3 is the newest.</p></div>
        <div id="content"><h1>Starting the pump</h1><p>{_MORE}</p><pre>pump --start now</pre><ol><li>Open the valve.</li><li>{_LONG}</li></ol><p>Done.</p></div>
        <div class="pager"><a href="/p">Previous page</a> <a href="/n">Next page</a></div><div class="footer">{_LONG}</div></body>""",
        "-" + "---" + "++++++" + "-" + "-",
    ),
    # a page that is only menus and notices
    (
        f"""<body><nav><p><a href="/1">Maps</a></p><p><a href="/2">Tides</a></p></nav><div class="notice">{_MID} Please come back later.</div>
        <div class="popup">{_LONG} <a href="/ok">Close</a></div><p><a href="/all">All pages of this site in one list</a></p><footer>{_MID}</footer></body>""",
        "--" + "-" + "-" + "-" + "-",
    ),
    # article in main only, aside and form inside, header and banner before
    (
        f"""<body><header><h1><a href="/">River times</a></h1><p>{_LONG}</p></header><div class="banner">{_MORE}</div>
        <main><h1>Reeds</h1><p>{_MID}</p><aside><p>{_LONG}</p><p>Did you know?</p></aside><p>{_MORE}</p><form><p>{_MID}</p></form><p>Reeds grow fast</p><p>{_LONG}</p></main>
        <div class="sidebar"><h4>Most read</h4><p>{_LONG}</p></div></body>""",
        "--" + "-" + "++" + "--" + "+" + "-" + "++" + "--",
    ),
    # article left open in an advert that never ends
    (
        f"""<body><div class="ad">{_LONG}<article><h1>Eels</h1><p>{_MORE}</p><p>Eels</p><p>{_MID}</p></article><div class="newsletter"><p>{_MID}</p><p>Sign up</p></div><footer><p>{_MORE}</p></footer></body>""",
        "-" + "++++" + "--" + "-",
    ),
    # plain pages whose markup names nothing: short lines next to links are not main text, paragraphs are
    (
        f"""<body><table><tr><td><a href="1">Rivers</a></td><td><a href="2">Lakes</a></td></tr></table>
        <div>You are here</div><div><a href="1">Rivers</a></div><div>{_LONG}</div><div>{_MORE}</div><div>{_LONG} {_MORE}</div>
        <div>Printed in spring</div><div><a href="3">Top of page</a></div><div>All rights kept</div></body>""",
        "--" + "--" + "+++" + "---",
    ),
    (
        f"""<body><div>Valley archive</div><div><a href="1">Maps of the valley and beyond</a></div><div>No. 12</div>
        <p>{_MORE} {_MID}</p><p>{_LONG}</p><p>{_MORE}</p><div>Page 4 of 9</div><div><a href="5">Next</a></div><div>Mill press</div></body>""",
        "---" + "+++" + "---",
    ),
    (
        f"""<body><p><a href="1">Home</a></p><p>Since 1901</p><p><a href="2">Contact us here</a></p><h1>Otters</h1><p>{_LONG}</p><p>{_MORE}</p><p>{_MID}</p>
        <p>{_LONG}</p><p><a href="3">More otters</a></p><p>Hosted free</p></body>""",
        "---" + "+++++" + "--",
    ),
    (
        f"""<body><div><a href="1">A</a> <a href="2">B</a> <a href="3">C</a></div><div>Est. 1888</div><div><h2>{_MID}</h2>{_MORE}<br>{_LONG}<br>{_MORE}</div>
        <div><a href="4">Write to the editor of this page</a></div><div>Since May</div></body>""",
        "--" + "++++" + "--",
    ),
    # named articles right between link lists: their short lines are main text
    (
        f"""<body><nav><a href="1">Home</a> <a href="2">Away</a></nav><article><p>Short start</p><p>{_LONG}</p><p>Short end</p></article>
        <footer><a href="3">Imprint</a></footer></body>""",
        "-" + "+++" + "-",
    ),
    (
        f"""<body><ul><li><a href="1">Home</a></li><li><a href="2">Away</a></li></ul><main><p>Pike</p><p>Perch</p><p><a href="4">All about the perch</a></p><p>Carp</p><p>{_MORE}</p><p>And bream</p></main>
        <div><a href="3">Imprint</a></div></body>""",
        "--" + "++-+++" + "-",
    ),
    (
        f"""<body><p><a href="1">Home</a></p><div class="entry-content"><p>Salt</p><p>{_LONG}</p><p>Pepper and thyme</p></div><p><a href="3">Next recipe</a></p></body>""",
        "-" + "+++" + "-",
    ),
    # pages that break off inside the article
    (
        f"""<body><nav><ul><li><a href="1">Home</a></li></ul></nav><div class="ad">{_MID}</div><article><h1>Trout</h1><p>Brown trout</p><p>Sea trout</p><p>Lake tr""",
        "-" + "-" + "++++",
    ),
    (
        f"""<body><div><a href="1">Home</a></div><article><p>One list of fish</p><p>Bleak and dace</p><p><a href="5">Read about the dace</a></p><p>Chub and roach</p><p><a href="6">Read about the roach</a></p><p>Tench or br""",
        "-" + "++-+-+",
    ),
    (
        f"""<body><nav><a href="1">Home</a></nav><main><p>Rain again today</p><p>{_LONG}</p></main><nav><a href="1">Home</a></nav><article><div>Sun at last today</div></article><nav><a href="2">Next</a></nav>
        <article><div>No wind at all</div><div>Some clouds</div></article><nav><a href="3">Last</a></nav><article><div>Fog in the valley""",
        "-" + "++" + "-" + "+" + "-" + "++" + "-" + "+",
    ),
]

_WORDS = "old boats lie upside down on the grey stones below the mill all winter long".split()


def _said(n: int) -> str:
    return " ".join(_WORDS[:n])


# The same lines of n words behind and before a linked line of k words: main text inside an article, else not.
for _k in (1, 3, 6, 10):
    for _n in (1, 2, 4, 8):
        LABELLED.append((f'<p><a href="1">{_said(_k)}</a></p><article><p>{_said(_n)}</p><p>{_LONG}</p><p>{_said(_n)}</p></article><p><a href="2">{_said(_k)}</a></p>', "-+++-"))
        if _n < 8:
            LABELLED.append((f'<p><a href="1">{_said(_k)}</a></p><p>{_said(_n)}</p><p>{_LONG}</p><p>{_MORE}</p><p>{_said(_n)}</p><p><a href="2">{_said(_k)}</a></p>', "--++--"))

# Lines of n words in what surrounds an article or plain paragraphs.
for _n in (2, 7, 12, 15):
    LABELLED += [
        (f"<header><p>{_said(_n)}</p></header><article><p>{_LONG}</p><p>{_said(_n)}</p></article><footer><p>{_said(_n)}.</p></footer>", "-++-"),
        (f"<header>{_said(_n)}</header><p>{_LONG}</p><p>{_MORE}</p><p>{_LONG}</p><aside>{_said(_n)}</aside><footer>{_said(_n)}.</footer>", "-+++--"),
        (f"<nav>{_said(_n)}</nav><div>{_LONG} {_MORE}</div><div>{_MORE} {_LONG}</div><form>{_said(_n)}</form><footer>{_LONG}</footer>", "-++--"),
        (f'<div class="menu">{_said(_n)}</div><div>{_MORE} {_LONG}</div><div>{_LONG} {_MORE}</div><div class="notice">{_said(_n)}.</div><div id="footer">{_MORE}</div>', "-++--"),
    ]

# Sentences with links in them, and lines that are hardly more than links.
for _n in (1, 2, 4):
    LABELLED += [
        (f'<nav><a href="1">{_MID}</a></nav><article><p>The cook of <a href="2">{_said(_n)}</a> said so.</p><p>{_LONG}</p><p>Ask <a href="3">{_said(_n)}</a> for {_said(_n)}.</p><p><a href="4">{_said(_n)}</a></p></article><footer><a href="5">{_said(_n)}</a></footer>', "-+++--"),
        (f'<p><a href="1">Home</a> | <a href="2">{_said(_n)}</a> | <a href="3">News</a></p><p>{_LONG}</p><p>The cook of the inn by the river and <a href="2">{_said(_n)}</a> said so.</p><p>{_MORE}</p><p><a href="1">{_said(_n)}</a> | <a href="2">Back</a></p>', "-+++-"),
    ]
