from hitweave.llm.mail import own_words


def test_first_tag_late_in_an_untyped_body():
    text = own_words("my words and more\n" * 200 + "<div>caf&eacute;</div><blockquote>old</blockquote>")
    assert "café" in text and "old" not in text and "<" not in text


def test_parts_of_parts_at_any_depth():
    text = "my words\n"
    for i in range(40):
        text = f"Content-Type: multipart/mixed; boundary=b{i}x\n\n--b{i}x\n{text}\n--b{i}x--\n"
    assert own_words("From: a@b.c\n" + text) == "my words"
