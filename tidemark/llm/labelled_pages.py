"""Labelled pages for the weights of the main-text operator: PAGES, twelve layouts written for this purpose.

The article of each page stands between the marks [[ and ]]; where other things stand inside of it, they
are between the marks {{ and }}. The set is fixed and small, so every worker fits the weights anew.
"""

PAGES = (
    "<body><div class=top><a href=1>home</a> <a href=2>news</a> <a href=3>sport</a></div><nav><ul><li><a href=4>one</a></li><li><a href=5>two things"
    "</a></li><li><a href=6>three</a></li></ul></nav><div class=ad>buy this lamp now and save a lot of money while it lasts</div><article>[[<h1>what "
    "happened on the hill</h1><p>it was a long day and <a href=7>many people</a> came up the hill to see the new bridge that was built</p><p>they "
    "stayed until the evening, when the lamps were lit and the <b>music</b> began</p><p>so it ended.</p>]]</article><footer>copyright someone "
    "<a href=8>terms</a> <a href=9>privacy</a> all rights of the pictures are with those who took them</footer></body>",
    "<body><table><tr><td><a href=1>index</a><br><a href=2>search</a></td><td>[[<h2>a short report</h2><p>the committee met twice this year and agreed "
    "on all of the points that had been left open before<p>no other matters were raised and the meeting was closed early in the afternoon<ul><li>the "
    "first point was carried by all who were there</li><li>the second point was put off</li></ul>]]</td></tr></table><div><form>your name <input>"
    "<button>send </button></form></div><div><a href=3>back</a> | <a href=4>up</a> | <a href=5>next</a></div></body>",
    "<body><header><div><a href=1>a site</a></div><div>sign in or join us</div></header><div id=content><div>[[<p>when water is heated in an open pot it "
    "boils at a temperature that depends on the height above the sea</p><blockquote><p>nobody had noticed this before</p></blockquote><p>today the "
    "effect is well known and taught in <i>every</i> school</p>]]</div></div><div class=comments><div class=comment><b>reader</b> nice text, i have "
    "seen this in my own kitchen</div><div class=comment><b>other</b> i don't agree at all with what was said here</div></div><aside><h3>more</h3><ul>"
    "<li><a href=2>a story</a></li><li><a href=3>another story</a></li></ul></aside></body>",
    "<body><div class='cookie notice' role=dialog>we use cookies to make this place better, by going on you agree to that <button>fine</button></div>"
    "<header class=masthead><h1><a href=/>the daily paper</a></h1><p>all the news of the valley</p></header><main><article>[[<header><h1>river rises "
    "again</h1><p>by our own reporter</p></header><section><p>after three days of rain the river has come over its banks in the lower town</p>"
    "{{<div class='advert banner'>an offer for you: boots at half the price in our shop in the high street</div>}}<p>the fire brigade has filled sacks with "
    "sand since the early morning</p><figure><img src=1><figcaption>the bridge on tuesday</figcaption></figure></section>]]</article></main><aside "
    "class=sidebar><h2>most read</h2><ol><li><a href=1>fair opens its gates</a></li><li><a href=2>school wins cup</a></li></ol></aside><section "
    "id=comments class='comments area'><h2>what readers say</h2><article class=comment><p>we saw it from our roof and it was quite a sight</p></article>"
    "<article class=comment><p>thank you for the report, stay safe all of you</p></article></section><footer class=footer><p>the daily paper is printed "
    "in the old mill</p></footer></body>",
    "<body>[[<h1>notes on bread</h1>flour, water and salt are all that it takes.<br>mix them in the evening and let them rest through the night.<br><br>in "
    "the morning heat the oven until it is as hot as it gets and bake for an hour.<pre>500 g flour\n350 g water\n10 g salt</pre>]]</body>",
    "<body><div class='navbar menu'><span>menu</span><ul><li><a href=a>products</a></li><li><a href=b>prices</a></li><li><a href=c>about us</a></li></ul>"
    "</div><div class='breadcrumb breadcrumbs'><a href=/>start</a> &gt; <a href=/x>manual</a> &gt; here</div><div class='page has-sidebar'><div "
    "class='post entry-content'>[[<h1>how to set the clock</h1><p>press the left button until the hours blink, then turn the wheel.</p><table><tr><th>button"
    "</th><th>what it does</th></tr><tr><td>left</td><td>chooses what to set</td></tr><tr><td>right</td><td>goes back a step</td></tr></table><dl><dt>wheel"
    "</dt><dd>turns both ways and clicks once a minute</dd></dl>]]</div><div class='sidebar widget'><h3>ask us</h3><p>our people are there for you from "
    "nine to five on all working days</p></div></div><div class='share social sharing'>tell your friends <a href=f>here</a> <a href=t>or there</a></div><div "
    "class='related'><h3>you may like</h3><p>how to change the strap in five easy steps</p></div></body>",
    "<body><div id=wrap><div id=header>a blog of small things</div><div id=main>[[<h2>on walking</h2><p>i walk to work each day, <em>whatever</em> the weather, "
    "and it takes me a little less than an hour.</p><p>there is a place where the path leaves the road and goes along the stream.</p><p>herons stand there."
    "</p>{{<form class=newsletter><p>get new notes by letter, no more than one in a month</p><input><button>subscribe</button></form>}}<p>in winter one can see "
    "the hills from there, and in summer nothing but leaves.</p>]]</div><div id=footer>written and drawn by hand since a long time ago</div></div>"
    "<div class='pagination pager'><a href=1>older</a> <a href=2>newer</a></div></body>",
    "<body><nav role=navigation><a href=1>a</a><a href=2>b</a></nav><div role=banner>your trusted source of tools</div><div class=content><div class=story>[[<h1>a "
    "new kind of saw</h1><h3>it cuts both ways</h3><p>makers of tools have long looked for a saw that can cut on the way back.</p><ul><li><p>it is light</p></li>"
    "<li><p>it is quiet</p></li></ul><p>the price has not been told yet, but it should be in the shops by the end of the year.</p>]]<div class='promo sponsored "
    "sponsor'>paid for by a friend of saws: come and see them all in our great hall</div><div class='subscribe popup modal'>join the club and get ten of "
    "everything for nothing</div></div></div><div role=contentinfo>made in the north, sent all over the world</div></body>",
    "<body><div class=ads>sale sale sale, all must go by sunday evening</div><div class=section>[[<p>the oldest tree of the park is a lime that was planted when "
    "the town got its rights.</p><p>its trunk is hollow and a child can stand in it.</p>]]</div><div class='disclaimer notices legal'>nothing on these pages is "
    "meant as advice of any kind and all of it may be wrong</div><div class='toolbar'><a href=p>print</a> <a href=m>mail</a></div><div id=disqus class="
    "'replies responses'><p>my grandfather played in that tree as a boy</p><p>so did mine, what a small world</p></div></body>",
    "<html><body><center><font size=2><a href=1>first</a> | <a href=2>last</a></font></center><hr>[[<p>dear friends,<p>this page has not been changed since it was "
    "put up, and it shall not be.<p>it tells of the summer in which we built the boat, of the wood we chose, and of the day when we brought it to the lake. "
    "<a href=p>pictures of the boat</a> are kept apart.<h3>the wood</h3><p>larch for the planks, oak for the keel.<address>the builders</address>]]<hr><center>"
    "<a href=g>guest book</a> <a href=w>web ring</a></center></body></html>",
    "<body><div class=container><div class=row><section class='col text'>[[<h1>why the sky is blue</h1><div class=lead>light of short waves is scattered more by "
    "the air than light of long waves.</div><div class=paragraph>that is why we see blue from all sides when the sun is high.</div>{{<aside class=note><h4>see "
    "also</h4><a href=1>red evenings</a></aside>}}<div class=paragraph>in the evening the way through the air is longer, and what is left is red.</div>]]</section>"
    "<section class='teaser teasers'><h4>next</h4><p>why the sea is green, and sometimes grey</p></section></div></div><div class='alert message warning'>this site "
    "will be down on friday night for some hours</div><footer><div class=links><a href=i>imprint</a><a href=k>contact</a></div><p>a work of many hands</p></footer>"
    "</body>",
    "<body><div class=banner>the best seeds come from us, try them this spring</div><div class='nav navigation'>go to <a href=1>shop</a> <a href=2>garden</a></div>"
    "<div class=body><div class=text>[[<p>sow the beans when the nights are mild.</p><ol><li>soak them for a day</li><li>put them two fingers deep</li><li>water "
    "them well</li></ol><p>after ten days they should be up.</p><details><summary>if they are not</summary><p>then the ground was too cold, and you should sow "
    "again.</p></details>]]</div><div class='review reviews rating'>five of five, all of mine came up</div><div class='author bio'>she has grown beans for all of "
    "her life</div></div></body>",
)
