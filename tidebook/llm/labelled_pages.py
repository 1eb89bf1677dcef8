"""Labelled web pages in the usual layouts, for the first weights of the page text.

Main text stands in elements that carry ``data-main``; what of them isn't main text carries ``data-out``. ``{n}`` stands
for n words. The pages are invented; they teach how elements and class words are used, not what texts say.
"""

PAGES = (
    # A weblog.
    """<body class="home blog"><div id="page" class="site hfeed"><header id="masthead" class="site-header"><p class="site-title"><a>{3}</a></p><p class="site-description">{5}</p>
    <nav id="site-navigation" class="main-navigation" role="navigation"><ul class="menu nav-menu"><li class="menu-item"><a>{1}</a><li class="menu-item"><a>{2}</a><li class="menu-item"><a>{1}</a></ul></nav></header>
    <div class="content-area"><div class="post entry" data-main><h1 class="entry-title">{6}</h1><div class="entry-content"><p>{60}<p>{45} <a>{3}</a> {20}<blockquote><p>{18}</p></blockquote><h2>{4}</h2><p>{50}<ul><li>{9}<li>{12}<li>{2}</ul><p>{30}
    <div class="sharedaddy social share-buttons" data-out><h3>{2}</h3><ul><li><a>{1}</a><li><a>{1}</a></ul></div><div class="related-posts related" data-out><h3>{2}</h3><ul><li><a>{6}</a><li><a>{5}</a></ul></div></div></div>
    <section id="comments" class="comments comments-area"><h2 class="comments-title">{3}</h2><ol class="comment-list"><li class="comment"><div class="comment-author">{2}</div><div class="comment-content"><p>{25}</p><p>{30}</p></div><div class="reply"><a>{1}</a></div><li class="comment"><div class="comment-content"><p>{14}</p></div></ol>
    <div id="respond" class="comment-respond"><form class="comment-form"><p>{8}</p></form></div></section></div>
    <aside id="secondary" class="sidebar widget-area" role="complementary"><section class="widget widget_search search"><form role="search">{1}</form></section><section class="widget"><h2 class="widget-title">{2}</h2><ul><li><a>{5}</a><li><a>{6}</a></ul></section><section class="widget"><p>{12}</p></section></aside>
    <footer id="colophon" class="site-footer" role="contentinfo"><div class="site-info">{8}</div></footer></div>""",
    # A newspaper, with notices, adverts and a newsletter in and around the text.
    """<body><div class="cookie-banner cookie-notice consent gdpr" role="dialog"><p>{30}</p><p>{12}</p></div><div class="alert notice announcement"><p>{15}</p></div><div class="topbar toolbar"><a>{1}</a><a>{2}</a></div>
    <div class="header masthead"><div class="logo">{2}</div><ul class="nav navbar"><li><a>{1}</a><li><a>{1}</a><li><a>{1}</a></ul></div><ul class="breadcrumb breadcrumbs"><li><a>{1}</a><li><a>{2}</a></ul><div class="ad advert advertisement banner">{7}</div>
    <div class="container"><div class="story article" data-main><h1 class="headline">{9}</h1><p class="lead intro">{28}<figure><figcaption class="caption">{11}</figcaption></figure><div class="article-body story-body"><p>{55}<p>{48}<div class="ad ads adsense sponsored" data-out><p>{9}</p></div><p>{62}<h2>{5}</h2><p>{40}<p>{1}
    <div class="newsletter newsletter-signup subscribe" data-out><h3>{4}</h3><p>{18}</p></div><p>{52}<aside class="pullout" data-out><p>{20}</p></aside><p>{33}<table><tr><th>{1}<th>{2}<tr><td>{1}<td>{3}</table><p>{26}</div></div>
    <div class="recommended recommendations promo"><h3>{3}</h3><ul><li><a>{8}</a><li><a>{7}</a></ul><p>{10}</p></div><div class="sidebar rail right-rail"><div class="widget trending"><h4>{2}</h4><ol><li><a>{8}</a><li><a>{9}</a></ol></div><div class="sponsor sponsored"><p>{16}</p></div></div></div>
    <div id="disqus_thread" class="discussion comments replies"><div class="comment"><p>{40}</p></div><div class="comment reply"><p>{22}</p></div></div><div class="modal popup overlay"><p>{14}</p><form>{3}</form></div><div class="footer"><ul class="footer-links"><li><a>{1}</a><li><a>{2}</a></ul><p class="copyright">{9}</p></div>""",
    # A manual.
    """<body><a class="skip skip-link">{4}</a><header class="header"><nav class="navbar"><a>{1}</a><a>{1}</a></nav><form class="searchbox search">{1}</form></header><div class="layout has-sidebar"><nav class="sidebar toc"><ul><li><a>{2}</a><ul><li><a>{3}</a><li><a>{2}</a></ul><li><a>{2}</a></ul></nav>
    <div class="markdown-body content documentation" data-main><h1>{3}</h1><p>{35}<h2>{2}</h2><p>{22}<pre>{20}</pre><ol><li>{10}<li><p>{14}<li>{6}</ol><div class="note admonition"><p>{18}</div><dl><dt>{1}<dd>{9}<dt>{2}<dd>{13}</dl><h3>{3}</h3><p>{44}<table><tr><td>{2}<td>{6}<tr><td>{1}<td>{8}</table><p>{8}</div>
    <div class="pagination pager"><a>{3}</a><a>{4}</a></div></div><footer class="footer"><p>{10}</p></footer>""",
    # Tables for layout.
    """<body><table><tr><td class="header">{4}</td></tr><tr><td class="leftmenu menu"><a>{1}</a><br><a>{2}</a><br><a>{1}</a></td><td class="content main text" data-main><h1>{4}</h1>{50}<br><br>{40}<p>{30}<p>{25}</td><td class="right ads"><a>{4}</a>{6}</td></tr><tr><td class="footer">{8}</td></tr></table>""",
    # A page in one form.
    """<body><form id="aspnetForm"><div class="header"><div class="title">{2}</div></div><div class="menu navigation"><ul><li><a>{1}</a><li><a>{1}</a></ul></div><div id="main-content" class="main content" data-main><h1>{5}</h1><p>{46}<p>{38}<div><p>{29}</div></div><div class="login signup"><p>{6}</p></div><div class="footer"><p>{12}</p></div></form>""",
    # Bare elements.
    """<body><header><h2>{2}</h2><p>{6}</p></header><nav><ul><li><a>{1}</a><li><a>{1}</a><li><a>{1}</a></ul></nav><div data-main><h1>{7}</h1><p>{40}<p>{52}<ul><li>{8}<li>{7}</ul><p>{36}<h2>{3}</h2><p>{20}<aside data-out><p>{15}</p></aside><p>{31}</div><aside><h3>{2}</h3><p>{18}</p></aside><section class="comments"><p>{20}</p></section><footer><p>{9}</p>{7}</footer>""",
    """<body><nav>{1} <a>{1}</a> <a>{2}</a></nav><header>{3}</header><div data-main><h1>{3}</h1><p>{10}<p>{4}<p>{25}<ol><li>{3}<li>{5}</ol><p>{6}</div><form>{4}</form><aside>{12}</aside><footer>{11}</footer><dialog>{9}</dialog><menu><li>{1}<li>{2}</menu>""",
    # Hardly any markup.
    """<body><div data-main><h1>{4}</h1><p>{33}<p>{2}<p>{18}</div><div class="nav"><a>{1}</a> <a>{1}</a></div>""",
    """<body><p data-main>{3}</p><p data-main>{20}</p><p data-main>{41}</p><div><a>{1}</a></div><div>{6}</div>""",
    """<body><center><b data-main>{5}</b></center><p data-main>{26}</p><p data-main>{14}</p><hr><div><a>{2}</a> | <a>{1}</a></div>""",
    # An answer and its replies; a shop; an encyclopedia.
    """<body><div class="nav-bar"><a>{1}</a></div><div class="thread"><h1 data-main>{8}</h1><div class="post first" data-main><div class="post-body"><p>{40}<p>{22}</div></div><div class="reply replies"><p>{30}</p></div><div class="reply"><p>{16}</p></div></div><div class="related"><a>{6}</a><a>{5}</a></div><div class="footer">{5}</div>""",
    """<body><div class="site-header"><a>{2}</a></div><div class="search">{1}</div><div class="product"><div class="description" data-main><h1>{5}</h1><p>{34}<ul><li>{6}<li>{8}<li>{7}</ul><p>{20}</div><div class="share social"><a>{1}</a><a>{1}</a></div><div class="recommendations"><p>{6}</p><p>{7}</p></div></div><div class="newsletter"><p>{11}</p></div><div class="legal copyright">{14}</div>""",
    """<body><div id="content" class="body" role="main" data-main><h1 id="firstHeading" class="title heading">{2}</h1><div id="bodyContent"><p>{70}<h2>{1}</h2><p>{48}<p>{39}<h3>{2}</h3><ul><li>{10}<li>{12}</ul><table class="data"><tr><th>{1}<td>{2}<tr><th>{1}<td>{4}</table><p>{27}<div class="toolbar menu" data-out><a>{1}</a></div></div></div><div id="navigation" class="menu panel"><ul><li><a>{2}</a><li><a>{2}</a></ul></div><div id="footer"><ul><li>{10}<li>{12}</ul></div>""",
    # Headers and sections within the text, and a thread of posts.
    """<body><header class="site-header"><a>{2}</a></header><div data-main><header><h1>{6}</h1><p class="byline">{4}</p></header><section><h2>{2}</h2><p>{42}<p>{31}</section><section class="section"><h2>{3}</h2><p>{27}<ul><li>{7}<li>{9}</ul></section><footer data-out><p>{6}</p></footer></div><footer>{7}</footer>""",
    """<body><header><nav><a>{1}</a><a>{1}</a></nav></header><div class="page"><div class="article" data-main><header class="article-header"><h1>{5}</h1></header><section class="article-section"><p>{35}<p>{50}</section></div><section class="related"><h3>{2}</h3><a>{5}</a><p>{9}</p></section></div><footer>{9}</footer>""",
    """<body><div class="header">{3}</div><div class="thread topic" data-main><h1>{5}</h1><div class="post"><p>{35}</div><div class="post"><p>{48}<p>{12}</div></div><div class="thread-list sidebar"><a>{4}</a><a>{5}</a><a>{3}</a></div><div class="footer">{6}</div>""",
    # Texts without markup.
    """<span data-main>{2}</span>""",
    """<span data-main>{9} <b>{3}</b> {30}</span>""",
    """<span data-main>{5}<br><br>{26}</span>""",
    # Parts around short texts, each with a paragraph.
    """<body><div class="header"><p>{6}</p></div><div class="nav"><p>{5}</p></div><div class="content" data-main><h1>{4}</h1><p>{22}<div class="ad" data-out><p>{8}</p></div><p>{17}<div class="share" data-out><p>{4}</p></div><p>{12}</div><div class="sidebar"><p>{14}</p><ul><li>{5}<li>{4}</ul></div><div class="footer"><p>{9}</p></div></body>""",
    """<body><div class="banner"><p>{7}</p></div><div class="menu"><p>{5}</p><ul><li>{2}<li>{2}</ul></div><div class="cookies"><p>{16}</p></div><div class="entry" data-main><h2>{4}</h2><p>{31}<p>{24}<ul><li>{9}<li>{3}</ul></div><div class="widget"><p>{9}</p></div><div class="related"><p>{8}</p></div><div class="comments"><p>{25}</p><p>{12}</p></div><div class="copyright"><p>{7}</p></div></body>""",
    """<body><div class="advertisement"><p>{6}</p></div><div class="breadcrumbs"><p>{3}</p></div><div class="text" data-main><h1>{5}</h1><p>{19}<p>{28}<ol><li>{8}<li>{11}</ol><div class="promo" data-out><p>{9}</p></div><p>{14}</div><div class="newsletter"><p>{10}</p></div><div class="social"><p>{4}</p></div><div class="popup"><p>{9}</p></div><div class="sponsor"><p>{7}</p></div><nav><p>{4}</p><ul><li>{2}<li>{3}</ul></nav><aside><p>{11}</p><ul><li>{4}</ul></aside></body>""",
    """<body><div class="masthead"><p>{6}</p></div><div class="navbar"><p>{4}</p></div><div class="alert"><p>{12}</p></div><div class="post" data-main><h1>{4}</h1><p>{26}<div class="advert" data-out><p>{5}</p></div><p>{21}<div class="ads" data-out>{6}</div><p>{17}<div class="toolbar" data-out><p>{3}</p></div><blockquote><p>{15}</blockquote><p>{23}</div><div class="pagination"><p>{4}</p></div><div class="search"><p>{3}</p></div><div class="login"><p>{5}</p></div><div class="notice"><p>{13}</p></div><div class="comment"><p>{21}</p></div><div class="disclaimer"><p>{18}</p></div></body>""",
    """<body><div class="topbar"><p>{5}</p></div><div class="notification"><p>{9}</p></div><div class="cookie"><p>{15}</p></div><div class="story" data-main><h1>{6}</h1><p>{32}<div class="sponsored" data-out><p>{8}</p></div><p>{26}<figure><figcaption>{7}</figcaption></figure><p>{19}</div><div class="rail"><p>{8}</p></div><div class="recommended"><p>{9}</p></div><div class="subscribe"><p>{7}</p></div><div class="modal"><p>{8}</p></div><div class="replies"><p>{17}</p></div><div class="discussion"><p>{22}</p></div><div class="footer-bottom"><p>{7}</p></div></body>""",
)
