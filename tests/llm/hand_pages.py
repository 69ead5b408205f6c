"""Pages written by hand in the manner of common sites; § starts the text of each article block."""

PAGES = [
    # a weblog
    """<!doctype html><html lang=en><head><meta charset=utf-8><title>Bread at home – Crumbs</title><link rel=stylesheet href=/s.css></head><body class="single single-post">
<a class="skip-link" href="#main">Skip to content</a><header class="site-header"><p class="site-title"><a href="/">Crumbs</a></p><nav class="main-navigation"><ul class="menu">
<li class=menu-item><a href=/about>About</a><li class=menu-item><a href=/contact>Contact</a></ul></nav></header><main id=main><article class="post hentry"><h1 class=entry-title>§Bread at home</h1>
<div class=entry-content><p>§It took me three years to bake a loaf that I'd give to a friend.<p>§The flour matters, but less than <a href=/water>the water</a>; and time matters most of all.
<h2>§What you need</h2><ul><li>§500 g of flour<li>§350 g of water<li>§10 g of salt</ul><blockquote>§“Wait until it is ready, not until the clock says so.”</blockquote><p>§Mix, fold, wait. Then bake it hot.</div></article>
<div id="comments" class="comments-area"><h2 class=comments-title>2 thoughts on “Bread at home”</h2><ol class=comment-list><li class=comment><p>Mine stayed flat, what did I do wrong?</p><li class=comment><p>Try a longer rest.</p></ol>
<form class=comment-form><label>Your comment</label><textarea>Say something</textarea><button>Post</button></form></div></main><aside class=widget-area><section class=widget><h3>Recent posts</h3><ul><li><a href=/x>Rye</a></ul></section></aside>
<footer class=site-footer>Proudly powered by flour.</footer></body></html>""",
    # news
    """<html><head><title>Bridge reopens</title><script type="application/ld+json">{"a":"<p>no</p>"}</script></head><body><div id="cookie-banner" role="dialog"><p>We and our partners use cookies. You can change your choices.</p><button>Accept all</button></div>
<div class="topbar"><a href=/>Home</a> <a href=/w>World</a> <a href=/s>Sport</a></div><div class="container"><div class="story-body"><h1>§Old bridge reopens after repairs</h1><p class=byline>§By our reporter</p>
<p>§The river bridge opened again on Monday after eleven months of work, a week before schedule.</p><div class="advert"><span>Advertisement</span></div><p>§The city said costs had stayed within the budget of four million.</p>
<figure><img src=b.jpg alt=bridge><figcaption>§The bridge on Monday morning.</figcaption></figure><p>§Buses will use it from Thursday.</p><div class="share-tools"><a href=#>Share</a><a href=#>Tweet</a></div></div>
<div class="sidebar"><h3>Most read</h3><ol><li><a href=1>Market days move to Friday</a><li><a href=2>Storm passes the coast</a></ol></div></div><div id=footer><p>© The River Post. All rights reserved.</p></div></body></html>""",
    # documentation
    """<!DOCTYPE html><html><body><nav class="toc"><ul><li><a href=#i>Install</a></li><li><a href=#u>Use</a></li></ul></nav><main><div class=section><h1>§Queue library</h1><p>§A queue that keeps its order across restarts.</p>
<h2 id=i>§Install</h2><pre><code>§make install PREFIX=/usr</code></pre><h2 id=u>§Use</h2><p>§Call <code>push</code> to add an item &amp; <code>pop</code> to take one; if a &lt; b, a comes first.</p>
<table><tr><th>§name<th>§meaning<tr><td>§limit<td>§the largest number of items</table></div></main><footer><p>Built from version 1.2. <a href=/src>View source</a></p></footer></body></html>""",
    # a page about comments
    """<html><body><div class=header><a href=/>Board</a></div><article class="comments-policy"><h1>§Our comments policy</h1><p>§We welcome comments from all readers, and we read every comment before it appears.</p>
<p>§A comment that insults others, or that advertises, isn't published. Replies follow the same rules.</p><p>§Questions about this policy can be sent by letter.</p></article><footer>Board 2020</footer></body></html>""",
    # a forum's first post in a plain layout
    """<body><table width=100%><tr><td class=menu><a href=a>Index</a> | <a href=b>Search</a> | <a href=c>Log in</a></td></tr></table><h1>§Repairing a leaking tap</h1><p>§My kitchen tap drips all night. I've changed the washer twice, and it is no better.</p>
<p>§Is the seat worn? How would I see that?</p><div class=adsbygoogle><p>Plumbers near you, call now.</p></div><div class="footer">Forum software, terms of use, privacy</div></body>""",
    # broken markup
    """<html><head><title>t<body><nav><a href=/>Start</a></nav><article><h1 class=it's>§A note on markup</h1><p data-x=it's>§Quotes in values aren't always closed.<p>§If a <b and c are true, nothing is lost.<div class="ad"><p>Buy now</div><p>§The end &hellip; of it""",
    # German magazine
    """<html lang=de><body><div class=consent><p>Wir verwenden Cookies, um unser Angebot zu verbessern.</p><button>Zustimmen</button></div><header><div class=logo>Gartenblatt</div><ul class=nav><li><a href=1>Beete</a><li><a href=2>Bäume</a></ul></header>
<main><section class=article><h1>§Rosen im Herbst schneiden</h1><p>§Wer im Herbst schneidet, lässt die Pflanze ruhen. Das alte Holz bleibt stehen.</p><p>§Nach dem ersten Frost, so raten viele, ist es zu spät.</p><h3>§Werkzeug</h3><p>§Eine scharfe Schere genügt.</p></section>
<aside class=related><h4>Mehr zum Thema</h4><p><a href=3>Tulpen setzen</a></p></aside></main><footer><ul><li><a href=i>Impressum</a><li><a href=d>Datenschutz</a></ul></footer></body></html>""",
    # a recipe with a newsletter box in its middle
    """<html><body><header><h2>Spoon</h2></header><div id=content><article><h1>§Lentil soup</h1><p>§A pot for four, ready within the hour.</p><div class="newsletter-signup"><p>Get recipes by email every Sunday.</p><form><input name=e><button>Subscribe</button></form></div>
<h2>§Method</h2><ol><li>§Chop the onions and fry them slowly.</li><li>§Add lentils, stock and a bay leaf.</li><li>§Simmer, season, serve.</li></ol></article></div><div class=popular-posts><p>Popular: <a href=1>Chickpeas</a></p></div></body></html>""",
    # no article
    """<html><body><nav><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></nav><form class=login><label>Name</label><input><label>Password</label><input><button>Sign in</button></form><footer>© 2021 Example</footer></body></html>""",
    # an encyclopedia
    """<html><body><div id=mw-head class=noprint><ul><li><a href=1>Read</a><li><a href=2>Edit</a></ul></div><div id=bodyContent class=mw-body><h1 id=firstHeading>§Heron</h1><div class=mw-content><p>§Herons are long-legged birds of fresh and coastal water.<sup><a href=#1>[1]</a></sup></p>
<h2>§Food</h2><p>§They eat fish, frogs and insects, standing still for a long time before they strike.</p><ul><li>§The grey heron hunts alone.</li><li>§The night heron hunts at dusk.</li></ul></div></div><div id=mw-navigation><h2>Navigation menu</h2><ul><li><a href=3>Main page</a></ul></div><div id=footer><ul><li>This page was last edited in May.</ul></div></body></html>""",
    # an article with its own header and footer elements and a share bar
    """<html><body><div class=page><nav class=breadcrumbs><a href=/>Home</a> / <a href=/t>Travel</a></nav><article><header><h1>§Two days on the coast path</h1></header><p>§The path starts behind the church, where the road ends.</p><p>§It climbs at once, and the village falls away.</p>
<div class=social-share><ul><li><a href=#>Send</a><li><a href=#>Pin</a></ul></div><p>§By evening we had seen three people and one seal.</p></article><section class=comments><h3>3 comments</h3><article class=comment><p>Lovely, we walked there last year.</p></article><article class=comment><p>Is there a bus back?</p></article></section></div></body></html>""",
    # a press text in divs alone
    """<html><body><div class=masthead><div class=brand>Northern Lines</div></div><div class=text><h1>§New ferry for the northern route</h1><div>§The company has ordered a ferry that runs on batteries.</div><div>§It carries 120 cars and will sail from next summer on.</div></div><div class=legal>Registered office: Harbour Street 1. Privacy. Terms.</div></body></html>""",
]
