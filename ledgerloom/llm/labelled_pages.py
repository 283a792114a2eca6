"""Small labelled pages, written for this repository: from them the weights of the content scan are learned.

Each is a list of (is content, markup) pieces in page order.
"""

MENU = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">World news</a></li><li><a href="/c">Sport</a></li></ul></nav>'

PAGES: list[list[tuple[bool, str]]] = [
    [
        (False, "<html><head><title>Rivers rise</title><style>p{margin:0}</style></head><body>" + MENU),
        (True, "<article><h1>Rivers rise after a week of rain</h1><p>The river rose by two metres on Tuesday and several roads along its banks had to be closed.</p><p>Officials expect the water to fall again by the weekend, if <b>no more rain</b> comes.<br></p></article>"),
        (False, '<aside><h3>Most read</h3><ul><li><a href="/1">One</a></li><li><a href="/2">Two</a></li></ul></aside><footer><p>Copyright of the publisher. <a href="/t">Terms</a></p></footer></body></html>'),
    ],
    [
        (False, '<body><header><a href="/">The Daily</a><form><input name="q"><button>Search</button></form></header><div class="menu"><a href="/x">A</a><a href="/y">B</a><a href="/z">C</a></div>'),
        (True, '<div class="story"><h2>A new bridge</h2><p>Work on the bridge began in spring, and most of its piers now stand in the water.</p><blockquote><p>We are early, said the engineer who leads the work.</p></blockquote><p>It will open to <a href="/cars">traffic</a> next year.</p></div>'),
        (False, '<div class="comments"><div><span>anna</span><p>Great!</p></div><div><span>ben</span><p>About time.</p></div></div><div class="footer"><a href="/p">Privacy</a><a href="/i">Imprint</a></div></body>'),
    ],
    [
        (False, '<body><div class="cookie"><p>We use cookies.</p><button>Accept</button></div><ul class="nav"><li><a href="/1">First</a></li><li><a href="/2">Second</a></li></ul><div class="ad"><a href="/buy">Buy now</a></div>'),
        (True, "<main><h1>How bread is baked</h1><p>Flour, water and salt are mixed and left to rest for an hour.</p><ul><li>Fold the dough four times while it rests.</li><li>Heat the oven well before the loaf goes in.</li></ul><p>After forty minutes the crust is dark and the loaf sounds hollow.</p></main>"),
        (False, '<div class="share"><a href="/f">Share</a><a href="/m">Mail</a></div><table><tr><td><a href="/k">Tags</a></td><td><a href="/l">Bread</a></td></tr></table></body>'),
    ],
    [
        (False, '<body><table><tr><td><a href="/">Start</a></td><td><a href="/s">Sitemap</a></td></tr></table><select><option>English</option><option>Deutsch</option></select>'),
        (True, "<div><p>The library keeps some four thousand maps, the oldest of them drawn by hand.</p><p>Readers may see them on Mondays. <em>Please write</em> a week before you come.</p><pre>Room 4, second floor</pre></div>"),
        (False, '<ol><li><a href="/r1">Related one</a></li><li><a href="/r2">Related two</a></li></ol><div><a href="/up">Top</a></div></body>'),
    ],
    [
        (False, '<body><form id="aspnetForm"><div class="layout has-sidebar"><div class="sidebar-left"><a href="/1">Forecast</a><a href="/2">Archive</a></div>'),
        (True, '<div class="story"><h2>Snow in the hills</h2><p>Snow fell above six hundred metres during the night, and two passes stay closed until Friday.</p><p>Ploughs were sent out <b>before dawn</b>, but the wind soon filled the roads again.</p></div>'),
        (False, '<div id="comments"><article class="comment-body"><p>Still snowing here.</p></article></div></div><input type="hidden"></form><div class="footer"><a href="/p">Privacy</a></div></body>'),
    ],
    [
        (False, '<body><nav><a href="/">Start</a></nav>'),
        (True, "<article><h1>The old mill</h1><p>The mill stood empty for thirty years until a baker from the next village bought it.</p><p>Its wheel turns again, and on Sundays it may be seen at work.</p></article>"),
        (False, '<aside><article><h3><a href="/t1">A teaser</a></h3><p>Read on.</p></article><article><h3><a href="/t2">Another teaser</a></h3></article></aside></body>'),
    ],
    [
        (False, '<body><div><span>The Valley Post</span></div><div>Tuesday, late edition</div><div><span>Four minutes</span></div><div><a href="/1">Valley</a> <a href="/2">Coast</a></div>'),
        (True, "<div><h1>A ferry returns</h1><p>After eleven years the ferry crosses the bay again, four times a day and once at night.</p><p>Its first passengers were two farmers and a school class.</p></div>"),
        (False, "<div>Copyright of the publisher</div><div>Printed in the valley</div><div><span>All rights reserved</span></div></body>"),
    ],
]
