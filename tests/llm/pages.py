"""Pages written by hand, each with the blocks of its main text."""

PAGES = [
    ("news article", """<!doctype html><html><head><title>River floods</title></head><body class="home"><header class="masthead"><a href="/">The Daily Post</a><nav><ul><li><a href="/uk">UK</a><li><a href="/world">World</a><li><a href="/sport">Sport</a></ul></nav></header>
<main><article class="story"><h1>River bursts its banks after night of rain</h1><p class="byline">By Anna Smith</p><p>Hundreds of people left their homes on Tuesday after the river rose by two metres overnight.</p><p>"We had ten minutes to get out," said one resident, who asked not to be named.</p>
<aside class="related"><h3>Related</h3><ul><li><a href="/1">How to prepare for a flood</a><li><a href="/2">Rain records broken</a></ul></aside><p>The water is expected to fall by the weekend, officials said.</p></article></main><footer><p>&copy; 2023 The Daily Post. All rights reserved.</p></footer></body></html>""",
     ["River bursts its banks after night of rain", "By Anna Smith", "Hundreds of people left their homes on Tuesday after the river rose by two metres overnight.", '"We had ten minutes to get out," said one resident, who asked not to be named.', "The water is expected to fall by the weekend, officials said."]),
    ("blog with entry header", """<body><div id="header"><h1><a href="/">Garden diary</a></h1><p>Notes from a small garden</p></div><article class="post-12 hentry"><header class="entry-header"><h2 class="entry-title">Planting garlic in autumn</h2></header><div class="entry-content"><p>Garlic likes a cold winter, so I plant it in October.</p><p>Break the bulb into cloves and push each one into loose soil.</p></div><footer class="entry-footer">Filed under: <a href="/t">vegetables</a>, <a href="/u">autumn</a></footer></article>
<section id="comments"><h3>2 comments</h3><ol><li><p>Great tips, thank you! I will try it this year.</p><li><p>Mine always rots. What am I doing wrong?</p></ol><form><textarea></textarea><input type=submit></form></section></body>""",
     ["Planting garlic in autumn", "Garlic likes a cold winter, so I plant it in October.", "Break the bulb into cloves and push each one into loose soil."]),
    ("nothing tells", """<html><body><div class="a1"><div class="a2"><a href="/">Home</a> <a href="/x">Shop</a> <a href="/y">Contact</a></div><div class="b7"><div class="b8"><h1>On walking slowly</h1><p>I used to walk fast, as if the street were a corridor between two rooms.</p><p>Now I stop at windows, at dogs, at the smell of bread.</p><p>It takes longer, and I arrive more often.</p></div></div><div class="c3">&copy; 2019 Walker. <a href="/p">Privacy</a></div></div></body></html>""",
     ["On walking slowly", "I used to walk fast, as if the street were a corridor between two rooms.", "Now I stop at windows, at dogs, at the smell of bread.", "It takes longer, and I arrive more often."]),
    ("grid of divs", """<body><div class=wrap><div class=row><div class=col><h1>How sound travels</h1><p>Sound is a wave of pressure that moves through air, water or steel.</p><p>In steel it is about fifteen times as fast as in air.</p></div></div></div></body>""",
     ["How sound travels", "Sound is a wave of pressure that moves through air, water or steel.", "In steel it is about fifteen times as fast as in air."]),
    ("sign-up box inside", """<body><nav class="navbar"><a href="/">Home</a><a href="/a">Archive</a></nav><article><h1>The price of eggs</h1><p>Eggs cost twice what they did a year ago, and nobody agrees on why.</p><div class="newsletter-signup"><h4>Never miss a story</h4><p>Get our newsletter in your inbox every Friday.</p><form><input type="email"><button>Sign up</button></form></div><p>Feed is dearer, and so is fuel, but that explains only half of it.</p></article></body>""",
     ["The price of eggs", "Eggs cost twice what they did a year ago, and nobody agrees on why.", "Feed is dearer, and so is fuel, but that explains only half of it."]),
    ("advert inside", """<body><div class="site-header"><a href="/">Cycling weekly notes</a></div><div id="content"><div class="post"><h1>A loop around the lake</h1><p>The loop is forty kilometres long and almost flat.</p><div class="ad-slot"><span>Advertisement</span><p>New tyres, now half price at Wheel World!</p></div><p>Start early, since the car park fills up by nine.</p></div></div><div class="sidebar"><h3>Popular posts</h3><ul><li><a href="/1">Best pumps</a><li><a href="/2">Winter gloves</a></ul></div></body>""",
     ["A loop around the lake", "The loop is forty kilometres long and almost flat.", "Start early, since the car park fills up by nine."]),
    ("german", """<html lang=de><body><header><a href=/>Stadtbote</a></header><div class="cookie-hinweis cookie-banner"><p>Diese Website verwendet Cookies. <button>Alle akzeptieren</button></p></div><article><h1>Neue Brücke eröffnet</h1><p>Nach drei Jahren Bauzeit ist die neue Brücke am Montag eröffnet worden.</p><p>Die Kosten lagen bei zwölf Millionen Euro, zwei mehr als geplant.</p></article><footer><a href=/impressum>Impressum</a> <a href=/datenschutz>Datenschutz</a></footer></body></html>""",
     ["Neue Brücke eröffnet", "Nach drei Jahren Bauzeit ist die neue Brücke am Montag eröffnet worden.", "Die Kosten lagen bei zwölf Millionen Euro, zwei mehr als geplant."]),
    ("french", """<body><nav id=menu><ul><li><a href=/>Accueil</a></li><li><a href=/c>Contact</a></li></ul></nav><main id=main><h1>Le marché du samedi</h1><p>On y trouve du pain, du fromage et des histoires.</p><p>Les premiers clients arrivent avant sept heures&nbsp;; les derniers, vers midi.</p></main><aside><h2>À lire aussi</h2><a href=/1>Les foires d'été</a></aside><footer>Mentions légales</footer></body>""",
     ["Le marché du samedi", "On y trouve du pain, du fromage et des histoires.", "Les premiers clients arrivent avant sept heures ; les derniers, vers midi."]),
    ("recipe", """<body><div class="top-bar"><a href="/">Kitchen</a> | <a href="/r">Recipes</a> | <a href="/l">Login</a></div><article class="recipe"><h1>Lentil soup</h1><p>A soup for cold evenings, ready in half an hour.</p><h2>Ingredients</h2><ul><li>200 g red lentils</li><li>One onion, chopped</li><li>A spoon of cumin</li></ul><h2>Method</h2><ol><li>Fry the onion until it is soft.</li><li>Add lentils, cumin and water, and simmer for twenty minutes.</li></ol></article><div class="share-buttons"><a href="#">Tweet</a> <a href="#">Print</a></div></body>""",
     ["Lentil soup", "A soup for cold evenings, ready in half an hour.", "Ingredients", "200 g red lentils", "One onion, chopped", "A spoon of cumin", "Method", "Fry the onion until it is soft.", "Add lentils, cumin and water, and simmer for twenty minutes."]),
    ("documentation", """<body><div class="sidebar-nav"><ul><li><a href="/i">Install</a></li><li><a href="/q">Quick start</a></li><li><a href="/f">FAQ</a></li></ul></div><div class="markdown-body"><h1>Quick start</h1><p>Create a file and run the tool on it.</p><pre><code>tool run file.txt</code></pre><p>The result is written next to the file.</p><table><tr><th>Option</th><th>Meaning</th></tr><tr><td>-v</td><td>print more</td></tr></table></div></body>""",
     ["Quick start", "Create a file and run the tool on it.", "tool run file.txt", "The result is written next to the file.", "Option", "Meaning", "-v", "print more"]),
    ("title class", """<body><h1 class="entry-title">A title outside</h1><div class="post"><p class="title">A first line that is styled like a title.</p><p>And a second one, which is not, follows it here.</p></div><div id="respond"><h3>Leave a reply</h3><p>Your email address will not be published.</p></div></body>""",
     ["A title outside", "A first line that is styled like a title.", "And a second one, which is not, follows it here."]),
    ("article-head", """<body><div class="article-head"><h1>Small words</h1></div><div class="article-body"><p>Short words carry most of what we say.</p><p>Long ones are for effect, or for lawyers.</p></div><footer class="site-footer">Copyright, all rights reserved</footer></body>""",
     ["Small words", "Short words carry most of what we say.", "Long ones are for effect, or for lawyers."]),
    ("two paragraphs", """<body><article><header><h1>Two paragraphs</h1></header><p>There is not much to say about it, really.</p><p>So this is all that there is, and it ends here.</p></article></body>""",
     ["Two paragraphs", "There is not much to say about it, really.", "So this is all that there is, and it ends here."]),
    ("table layout", """<html><body bgcolor=white><table width=100%><tr><td width=120><a href=a.html>Home</a><br><a href=b.html>Links</a><br><a href=c.html>Guestbook</a></td><td><h1>My holiday in Norway</h1><p>We took the boat from Bergen and it rained for six days.<p>On the seventh the sun came out, and we saw why people live there.</td></tr></table></body></html>""",
     ["My holiday in Norway", "We took the boat from Bergen and it rained for six days.", "On the seventh the sun came out, and we saw why people live there."]),
    ("unclosed", """<body><ul class=menu><li><a href=/>Home<li><a href=/b>Blog</a></ul><div class=story><h1>No end tags<p>This page leaves out every end tag that it can.<p>Browsers read it <b>anyway, and so do we.<p>The end.</div><div class=footer>Contact us</div>""",
     ["No end tags", "This page leaves out every end tag that it can.", "Browsers read it anyway, and so do we.", "The end."]),
    ("comments like text", """<body><article class="entry"><h1>Why I left the city</h1><p>The rent was one reason, but not the main one.</p><p>I wanted to hear nothing at night, and now I do.</p></article><div class="comment-list"><div class="comment"><b>Paul</b><p>I did the same ten years ago and never looked back. The first winter is hard, though.</p></div><div class="comment"><b>Mia</b><p>Interesting read, but what about work? Not everyone can do this.</p></div></div></body>""",
     ["Why I left the city", "The rent was one reason, but not the main one.", "I wanted to hear nothing at night, and now I do."]),
    ("notice on top", """<body><div class="alert"><p>Our offices are closed on Monday. We apologise for the inconvenience.</p></div><header class="site-header"><h1>City library</h1><nav><a href="/">Start</a><a href="/h">Opening hours</a></nav></header><div class="content"><h2>Reading group</h2><p>The reading group meets on the first Thursday of each month.</p><p>In March we read a short novel about a lighthouse.</p></div></body>""",
     ["Reading group", "The reading group meets on the first Thursday of each month.", "In March we read a short novel about a lighthouse."]),
    ("svg and quotes", """<body><svg/><nav><a href="/" title="it's home">Home</a></nav><article data-x=it's><h1>Don't panic</h1><p data-note="a > b">Markup may hold an angle bracket or an apostrophe.</p><p>Readers of it shouldn't mind, and they shouldn't lose text.</p></article><svg><text>icon</text></svg></body>""",
     ["Don't panic", "Markup may hold an angle bracket or an apostrophe.", "Readers of it shouldn't mind, and they shouldn't lose text."]),
    ("open textarea", """<body><article><h1>Forms that never end</h1><p>Some pages open a text field and forget about it.</p><p>What comes after it is still a page.</p></article><form><textarea name=q></form><footer>All rights reserved</footer></body>""",
     ["Forms that never end", "Some pages open a text field and forget about it.", "What comes after it is still a page."]),
    ("quote and figure", """<body><div class="breadcrumb"><a href="/">Home</a> &gt; <a href="/art">Art</a></div><article><h1>A painter of light</h1><figure><img src=a.jpg><figcaption>The harbour at dawn, 1881.</figcaption></figure><p>She painted the harbour forty times, always before six.</p><blockquote>The light is honest only for an hour.</blockquote><p>Most of these pictures hang in one small museum.</p></article></body>""",
     ["A painter of light", "The harbour at dawn, 1881.", "She painted the harbour forty times, always before six.", "The light is honest only for an hour.", "Most of these pictures hang in one small museum."]),
    ("utility classes", """<body class="antialiased"><div class="flex px-4 py-2"><a class="mr-4" href="/">Acme</a><a class="mr-4" href="/pricing">Pricing</a><a href="/login">Log in</a></div><div class="max-w-2xl mx-auto"><h1 class="text-3xl">Shipping less, better</h1><p class="mt-4">We removed eleven features last year and nobody wrote to complain.</p><p class="mt-4">What is left is faster, and we understand it.</p></div><div class="border-t py-8 text-sm"><a href="/terms">Terms</a> <a href="/privacy">Privacy</a> &copy; Acme Inc.</div></body>""",
     ["Shipping less, better", "We removed eleven features last year and nobody wrote to complain.", "What is left is faster, and we understand it."]),
    ("sections", """<body><header class="header"><div class="logo">Botany online</div></header><main><h1>Mosses</h1><section><h2>Where they grow</h2><p>Mosses grow where other plants give up: on stones, roofs and bark.</p></section><section><h2>How they drink</h2><p>They have no roots, so they drink through their leaves.</p></section></main><footer><ul><li><a href="/about">About</a></li><li><a href="/contact">Contact</a></li></ul></footer></body>""",
     ["Mosses", "Where they grow", "Mosses grow where other plants give up: on stones, roofs and bark.", "How they drink", "They have no roots, so they drink through their leaves."]),
    ("share bar inside", """<body><article><h1>The last bakery</h1><div class="social-share"><a href="#f">Share on Facebook</a> <a href="#t">Tweet</a></div><p>The last bakery in the village closed on a Sunday.</p><p>Its oven had been lit for a hundred and four years.</p><div class="tags">Tags: <a href="/t1">village</a> <a href="/t2">bread</a></div></article></body>""",
     ["The last bakery", "The last bakery in the village closed on a Sunday.", "Its oven had been lit for a hundred and four years."]),
    ("spanish", """<body><div id="cabecera" class="header"><a href="/">El Faro</a></div><div class="menu"><a href="/">Inicio</a> <a href="/d">Deportes</a></div><div class="noticia article"><h1>Vuelve el tren nocturno</h1><p>El tren nocturno volverá a circular en junio, tras cinco años.</p><p>Los billetes se venden desde hoy, y los primeros ya se han agotado.</p></div><div class="publicidad ad">Compra ahora y ahorra</div><div class="footer">Aviso legal</div></body>""",
     ["Vuelve el tren nocturno", "El tren nocturno volverá a circular en junio, tras cinco años.", "Los billetes se venden desde hoy, y los primeros ya se han agotado."]),
    ("only a menu", """<html><body><nav><ul><li><a href="/a">Products</a></li><li><a href="/b">Services</a></li></ul></nav><footer>Copyright 2020. All rights reserved.</footer></body></html>""", []),
    ("deep nest", "<body><nav><a href=/>Home</a><a href=/n>News</a></nav>" + "<div class='x'>" * 15 + """<div class="story"><h1>Fifteen boxes deep</h1><p>Some builders wrap a page in box after box after box.</p><p>The text inside is the same as it would be without them.</p></div>""" + "</div>" * 15 + "<div class='footer'>Terms of use</div></body>",
     ["Fifteen boxes deep", "Some builders wrap a page in box after box after box.", "The text inside is the same as it would be without them."]),
    ("scripts between", """<body><script>if (a < b) { document.write("<p>no</p>"); }</script><article><h1>Static pages</h1><p>A page without scripts loads at once.</p><script>track('x')</script><style>p{}</style><p>This one has two, and neither is text.</p></article><noscript>Please enable JavaScript</noscript></body>""",
     ["Static pages", "A page without scripts loads at once.", "This one has two, and neither is text."]),
    ("related at the end", """<body><header><a href="/">Science now</a></header><article class="single"><h1>Octopus dreams</h1><p>Sleeping octopuses change colour, which may mean that they dream.</p><p>Nobody can ask them, of course, but the patterns repeat.</p></article><div class="related-posts"><h3>You may also like</h3><div class="card"><h4><a href="/1">How bees count</a></h4><p>Bees know zero, a study says.</p></div><div class="card"><h4><a href="/2">Crows and tools</a></h4><p>Crows bend wire into hooks.</p></div></div></body>""",
     ["Octopus dreams", "Sleeping octopuses change colour, which may mean that they dream.", "Nobody can ask them, of course, but the patterns repeat."]),
    ("text in divs", """<body><div class="menu-top"><a href="/">Home</a></div><div class="text"><div>My grandmother kept bees, and she spoke to them every morning.</div><div>When she died somebody had to tell the bees, and it was me.</div></div><div class="bottom">Contact | <a href="/i">Imprint</a></div></body>""",
     ["My grandmother kept bees, and she spoke to them every morning.", "When she died somebody had to tell the bees, and it was me."]),
    ("login form", """<body><div class="login-box"><form><label>User name</label><input><label>Password</label><input type=password><button>Log in</button></form></div><div class="main"><h1>Minutes of the meeting</h1><p>The meeting began at seven with eleven members present.</p><p>It was agreed to paint the fence green.</p></div></body>""",
     ["Minutes of the meeting", "The meeting began at seven with eleven members present.", "It was agreed to paint the fence green."]),
    ("no head end", """<html><head><title>Old page</title><meta name=author content=me><body><h1>An old page</h1><p>Nobody closed the head of this page, and it still has a body.</p><p>It was written in a text editor, long ago.</p><hr><address>Mail me: me@example.com</address></body></html>""",
     ["An old page", "Nobody closed the head of this page, and it still has a body.", "It was written in a text editor, long ago."]),
]
