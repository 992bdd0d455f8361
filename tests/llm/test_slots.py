"""Main text of pages whose article element holds a part of it only."""

from conftest import rows

from tessera.llm import html


def test_slots_beside_an_article_are_kept(spark):
    body = "<body><nav>n</nav><div>Our notice</div><div>Text {i} before the card</div><article><p>Card {i}</p></article><section><p>Text {i} after it</p></section><div>All rights</div></body>"
    pages = [(i, "http://h/", body.format(i=i)) for i in range(4)]
    found = html.extract(spark.createDataFrame(pages, "page_id long, url string, html string"))
    assert rows(found, "page_id", "text") == [(i, f"Text {i} before the card\nCard {i}\nText {i} after it") for i in range(4)]
