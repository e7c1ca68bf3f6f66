"""A small labelled table of page blocks: the layouts on which the tree of ``html_text`` is grown.

Each entry is a page.  ``[+9]`` stands for nine words that begin a block of main
text, ``[-9]`` for nine that begin another one, ``[9]`` for nine more words.
"""

from __future__ import annotations

import re

_HEAD = "<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body>"
_MENU = "<nav><ul><li><a href=/>[-1]</a></li><li><a href=/>[-1]</a></li><li><a href=/>[-2]</a></li></ul></nav>"
_TOP = "<header><div><a href=/>[-2]</a></div><p>[-7]</p></header>"
_END = "<footer><p>[-8]</p><ul><li><a href=/>[-1]</a></li><li><a href=/>[-3]</a></li></ul></footer></body></html>"
_SHORT = "<h1>[+7]</h1><p>[+1]</p><p>[+3]</p><p>[+44]</p><p>[+2]<p>[+80]<p>[+1]"

LABELLED = (
    # an article between a menu, an advert and a footer; short and long paragraphs, some of links alone
    f"{_HEAD}{_MENU}<div class=ad>[-9]</div><article>{_SHORT}</article>{_END}",
    f"{_HEAD}{_MENU}<div class=ad>[-40]</div><article><h1>[+1]</h1><p>[+2]</p></article><footer>[-12]</footer>",
    f"{_HEAD}{_TOP}<article><h1>[+4]</h1><p>[+60]<a>[2]</a>[9]</p><ul><li>[+4]</li><li>[+22]</li><li><a>[+3]</a></li></ul><p><a>[+5]</a></p></article>{_END}",
    f"{_HEAD}<main><h1>[+9]</h1><h2>[+3]</h2><p>[+50]</p><table><tr><td>[+2]</td><td>[+1]</td></tr></table><blockquote>[+30]</blockquote></main>{_END}",
    f"{_HEAD}<div role=main><h1>[+5]</h1><p>[+5]</p><pre>[+20]</pre><figure><figcaption>[+9]</figcaption></figure></div><footer>[-30]</footer>",
    # parts inside the article that do not belong to it
    f"{_HEAD}<article><header><h1>[+6]</h1><p>[-4]</p><div>[-2]</div></header><p>[+70]</p><aside><h3>[-2]</h3><p>[-25]</p></aside><p>[+1]</p><footer>[-6]</footer></article>",
    f"{_HEAD}<article><h1>[+5]</h1><p>[+33]</p><div class=ad-slot>[-5]</div><p>[+8]</p><nav><a>[-2]</a><a>[1]</a></nav><div class=share><a>[-1]</a></div></article>{_END}",
    f"{_HEAD}<article><p>[+40]</p><p>[+4]</p><section class=comments><h2>[-2]</h2><article class=comment><p>[-30]</p><p>[-2]</p></article><form><label>[-3]</label><p>[-9]</p></form></section></article>",
    f"{_HEAD}<article><h2>[+3]</h2><p>[+2]</p><div class=newsletter><h3>[-3]</h3><p>[-28]</p></div><p>[+90]</p><div style='display:none'>[-30]</div></article>",
    f"{_HEAD}<main><nav class=breadcrumb><a>[-1]</a></nav><h1>[+4]</h1><p>[+60]</p><form><h3>[-2]</h3><p>[-30]</p></form><aside class=related><h2>[-2]</h2><p>[-18]</p></aside></main>",
    # parts beside the article
    f"{_HEAD}<div id=cookie-notice><h2>[-3]</h2><p>[-35]</p></div><article><p>[+1]</p></article><aside><h2>[-2]</h2><p>[-60]</p><ul><li>[-12]</li></ul></aside>",
    f"{_HEAD}<div class=sidebar><h3>[-1]</h3><p>[-50]</p></div><article><h1>[+30]</h1></article><div id=comments><h3>[-2]</h3><p>[-70]</p><p>[-1]</p></div>{_END}",
    f"{_HEAD}<p>[-6]</p><div>[-30]</div><h2>[-3]</h2><article><h1>[+8]</h1><p>[+1]</p><p>[+25]</p></article><p>[-25]</p><div>[-3]</div><ul><li><a>[-4]</a></li></ul>",
    f"{_HEAD}<form><p>[-20]</p><button>[-1]</button></form><main><p>[+3]</p><p>[+3]</p></main><dialog><h2>[-3]</h2><p>[-40]</p></dialog>",
    f"{_HEAD}<h1>[-2]</h1><section class=promo><h2>[-5]</h2><p>[-33]</p></section><article><h2>[+5]</h2><p>[+33]</p></article><section class=widget><p>[-12]</p></section>",
    # pages without an article element: long runs without links, and what is short between them
    f"{_HEAD}{_MENU}<div id=content><h1>[+6]</h1><p>[+45]</p><p>[+3]</p><p>[+60]</p><p>[+25]<a>[2]</a></p></div><div class=sidebar><h2>[-2]</h2><p>[-40]</p></div>{_END}",
    f"{_HEAD}<div class=top><a>[-1]</a> <a>[1]</a></div><div><h2>[+5]</h2><p>[+80]</p><p>[+12]</p><p>[+30]</p></div><div><a>[-4]</a></div><div><a>[-3]</a></div>",
    f"{_HEAD}<div id=header>[-5]</div><p>[+30]</p><p>[+50]</p><p>[+16]</p><div class=comments><p>[-40]</p></div><div id=footer><p>[-30]</p></div>",
    f"{_HEAD}<ul><li><a>[-2]</a></li><li><a>[-1]</a></li></ul><p>[+28]</p><p>[+6]</p><p>[+40]</p><ul><li><a>[-6]</a></li><li><a>[-7]</a></li></ul><p>[-3]</p>",
    f"{_HEAD}<div class=advert>[-30]</div><h1>[+4]</h1><div>[+100]</div><div>[+35]</div><p>[-4]<a>[3]</a></p><div class=legal>[-25]</div>",
    f"{_HEAD}<p>[-5]</p><div>[-7]</div><h1>[+7]</h1><p>[+38]</p><p>[+5]</p><p>[+64]</p><p>[+2]</p><p>[+31]</p><p>[-6]</p><p>[-8]</p><p>[-5]</p>",
    f"{_HEAD}<div>[-6]</div><div><a>[-2]</a></div><div>[-8]</div><h2>[+4]</h2><div>[+55]</div><div>[+9]</div><div>[+27]</div><div>[-5]</div><div><a>[-6]</a></div>",
    f"{_HEAD}<p><a>[-14]</a></p><p><a>[-22]</a></p><h1>[+3]</h1><p>[+14]</p><p>[+2]</p><p>[+19]</p><p>[+6]</p><p>[+12]</p><p><a>[-12]</a></p><p><a>[-33]</a></p>",
    f"{_HEAD}<div>[-4]<a>[5]</a></div><h1>[+5]</h1><p>[+25]</p><p>[+1]</p><p>[+22]</p><p>[+20]</p><p>[+4]</p><p>[+30]<a>[3]</a></p><p>[-3]</p><p><a>[-9]</a></p>",
    "[+40]<br>[10]",
)


def filled(page: str) -> str:
    """The page with words in place of numbers; a block's sign begins its first word."""
    return re.sub(r"\[([+-]?)(\d+)\]", lambda m: " " + m[1] + "word " * int(m[2]), page)
