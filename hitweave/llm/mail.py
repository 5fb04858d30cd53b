"""The sender's own words in a raw message: body parts decoded, without headers, attachments, quoted or forwarded
messages, signatures, closing formulas and what follows them, disclaimers, postscripts and remarks in brackets."""

from __future__ import annotations

import binascii
import html
import quopri
import re

#: Names of headers by which a message or part is known to begin with headers.
_HEADERS = r"(?:from|to|cc|bcc|date|sent|subject|sender|reply-to|return-path|received|message-id|in-reply-to|references|mime-version|content-[a-z-]+|x-[a-z-]+|delivered-to|list-[a-z-]+|importance|priority)"
_HEAD = re.compile(rf"\s*(?:From [^\n]*\n)?{_HEADERS}[ \t]*:[^\n]*(?:\n|$)", re.I)
_BOUNDARY = re.compile(r"boundary\s*=\s*\"?([^\";\s]+)", re.I)
_TAGS = re.compile(r"<[^>]*>")
_QUOTE = re.compile(r"^\s*[>|]")
_RULED = re.compile(r"^\s*-{2,}\s*[^\W\d_].*?-{2,}\s*$")
#: Verbs of the line above a quoted message, in four languages.
_WROTE = re.compile(r"\b(?:wrote|schrieb|a écrit|ecrit|escribió|escribio)\b.*:\s*$", re.I)
_NAME = re.compile(r"^\s*(?:on|am|le|el)\b.*?(?:,|schrieb)\s*|\b(?:wrote|a écrit|escribió)\b.*$", re.I)
_SIGNATURE = re.compile(r"^(?:--|_{4,}|={4,})\s*$")
#: Closing formulas, in four languages.
_CLOSING = re.compile(
    r"^(?:best|best regards|best wishes|kind regards|warm regards|regards|cheers|thanks|thank you|many thanks|thx|yours|sincerely|all the best|take care"
    r"|viele grüße|viele gruesse|liebe grüße|beste grüße|schöne grüße|gruß|gruss|grüße|lg|vg|mfg|mit freundlichen grüßen|bis bald"
    r"|cordialement|bien cordialement|bien à toi|bien à vous|amicalement|à bientôt|a bientôt|bonne journée|salutations|merci"
    r"|saludos|un saludo|un abrazo|abrazos|atentamente|cordialmente|hasta pronto|gracias)\s*[,.!]?\s*$",
    re.I,
)
#: Words of disclaimers, in four languages.
_DISCLAIMER = (
    "confidential", "unauthorised use", "unauthorized use", "investment advice", "before printing", "viruses", "virus-free", "registered office", "not medical advice", "no contract is formed", "unsubscribe",
    "vertraulich", "gerichtsstand", "haftung für", "anlageberatung", "vor dem ausdrucken", "vor dem drucken", "handelsregister",
    "confidentiel", "seul compétent", "avant d'imprimer", "responsabilité est exclue", "conseil en investissement",
    "confidencial", "antes de imprimir", "asesoramiento", "responsabilidad", "domicilio social",
)
_POSTSCRIPT = re.compile(r"^\s*(?:p\.?\s?s\.?|n\.?b\.?|btw|übrigens|au fait|por cierto)\s*[:,.]", re.I)
_BRACKETED = re.compile(r"^\s*\([^()]*\)\s*$", re.S)
_BROKEN = re.compile("[Â-ô][\u0080-¿ŒœŠšŸŽžƒˆ˜–—‘-„†-•…‰‹›€™]{1,3}")
_BASE64 = re.compile(r"^[A-Za-z0-9+/\s]{40,}={0,2}\s*$")


def _head(text: str) -> tuple[dict[str, str], str]:
    """Headers (unfolded, names in lower case) and the rest; no headers if the text doesn't begin with one."""
    if not _HEAD.match(text):
        return {}, text
    head, _, body = text.lstrip("\n").partition("\n\n")
    out: dict[str, str] = {}
    for line in re.sub(r"\n[ \t]+", " ", head).split("\n"):
        name, colon, value = line.partition(":")
        if colon:
            out.setdefault(name.strip().lower(), value.strip())
    return out, body


def _decode(body: str, coding: str, charset: str) -> str:
    coding = coding.strip().lower()
    if coding == "base64" or (not coding and _BASE64.match(body) and " " not in body.strip()):
        packed = re.sub(r"[^A-Za-z0-9+/]", "", body)
        try:
            data = binascii.a2b_base64(packed + "=" * (-len(packed) % 4))
        except binascii.Error:
            data = binascii.a2b_base64(packed[: len(packed) // 4 * 4])
    elif coding == "quoted-printable" or (not coding and re.search(r"=\n", body) and re.search(r"=[0-9A-F]{2}", body)):
        data = quopri.decodestring(body.encode("utf-8", "replace"))
    else:
        return body
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        try:
            return data.decode(charset if charset else "cp1252")
        except (UnicodeDecodeError, LookupError):
            return data.decode("latin-1")


def _from_html(text: str) -> str:
    text = re.sub(r"(?is)<(style|script|head|blockquote)\b.*?</\1\s*>", " ", text)
    text = re.sub(r"(?i)<br\s*/?>|</(?:p|div|tr|li|h\d)\s*>", "\n", text)
    return html.unescape(_TAGS.sub("", text))


def _texts(text: str) -> list[str]:
    """The readable parts of a message, in order, however deep they lie in parts of parts."""
    out, todo = [], [text]
    while todo:
        head, body = _head(todo.pop())
        kind = head.get("content-type", "").lower()
        edge = _BOUNDARY.search(head.get("content-type", ""))
        mark = edge[1] if edge else None
        if mark is None and (m := re.match(r"\s*--(\S+)\nContent-", body)):
            mark = m[1]
        if mark and f"--{mark}" in body:
            parts = body.split(f"--{mark}")
            found = [(p, _head(p.lstrip("\n"))[0]) for p in parts[1:] if p.strip() not in ("", "--")]
            found = [(p, h) for p, h in found if "attachment" not in h.get("content-disposition", "").lower() and "name=" not in h.get("content-type", "").lower()]
            plain = [p for p, h in found if not h.get("content-type", "").lower().startswith("text/html")]
            todo += [p.lstrip("\n") for p in reversed(plain or [p for p, _ in found])]
            continue
        if kind and not kind.startswith("text/") and not kind.startswith("multipart/"):
            continue
        charset = re.search(r"charset\s*=\s*\"?([\w-]+)", kind)
        body = _decode(body, head.get("content-transfer-encoding", ""), charset[1] if charset else "").replace("\r\n", "\n").replace("\r", "\n")
        if kind.startswith("text/html") or re.search(r"(?i)<(?:html|body|div|p|br)\b", body):
            body = _from_html(body)
        out.append(body)
    return out


def _repair(m: re.Match) -> str:
    try:
        return m[0].encode("cp1252").decode("utf-8")
    except UnicodeError:
        try:
            return m[0].encode("latin-1").decode("utf-8")
        except UnicodeError:
            return m[0]


#: Words that open a message, in four languages.
_GREETING = re.compile(
    r"^(?:(?:hi|hello|hey|dear|hallo|liebe[rs]?|guten tag|guten morgen|sehr geehrte[rs]?|moin|bonjour|salut|chers?|chères?|hola|buenos días|buenas tardes|estimad[oa]s?|querid[oa]s?)\b[^.?!]{0,40}[,:!]?|[^\W\d_]+(?: [^\W\d_]+)? ?[-–,])\s*$",
    re.I,
)


def _below(lines: list[str], author: str) -> list[str]:
    """What the sender wrote below or inside of a quoted message of author that no marks set off."""
    n = 0
    while n < len(lines) and (not lines[n].strip() or _HEAD.match(lines[n]) or re.match(r"^\s*(?:von|an|gesendet|betreff|de|à|envoyé|objet|para|enviado|asunto)\s*:", lines[n], re.I)):
        if re.match(r"^\s*(?:from|von|de)\s*:", lines[n], re.I):
            author = lines[n].partition(":")[2].strip()
        n += 1
    lines = lines[n:]
    first = author.split(" ")[0].strip('"<').lower() if author else ""
    closings = [i for i, x in enumerate(lines) if _CLOSING.match(x.strip())]
    named = [next((x.lower() for x in lines[i + 1 : i + 3] if x.strip()), "") for i in closings]
    theirs = next((i for i, x in zip(closings, named) if first and first in x), None)
    own = next((i for i, x in zip(reversed(closings), reversed(named)) if not first or first not in x), None)
    if theirs is not None and (own is None or theirs < own):
        start = theirs + 1
        while start < len(lines) and lines[start].strip():
            start += 1
        return lines[start:]
    stop = len(lines) if own is None else own
    greetings = [i for i in range(1, stop) if _GREETING.match(lines[i].strip()) and not lines[i - 1].strip()]
    return lines[greetings[-1] : stop] if greetings else []


def _own_lines(lines: list[str]) -> list[str]:
    out: list[str] = []
    skip_block = False
    for i, line in enumerate(lines):
        if skip_block:
            if line.strip():
                continue
            skip_block = False
        if _QUOTE.match(line):
            continue
        if _SIGNATURE.match(line.strip()):
            skip_block = True
            continue
        if _RULED.match(line):
            if not any(x.strip() for x in out):
                out = _own_lines(_below(lines[i + 1 :], ""))
            break
        if line.rstrip().endswith(":") and _WROTE.search(line):
            after = next((x for x in lines[i + 1 :] if x.strip()), "")
            if out and out[-1].strip() and re.search(r"(?i)\b(?:on|am|le|el)\b.*[<,]\s*$|<[^>]*>\s*$", out[-1]):
                out.pop()  # an attribution over two lines
            if after and not _QUOTE.match(after):
                if not any(x.strip() for x in out):
                    out = _own_lines(_below(lines[i + 1 :], _NAME.sub("", line)))
                break
            continue
        out.append(line)
    return out


def _disclaims(paragraph: str) -> bool:
    low = paragraph.lower()
    return any(w in low for w in _DISCLAIMER)


def own_words(text: str | None) -> str:
    """The sender's own running text; empty for null and empty messages."""
    if not text:
        return ""
    text = text.replace("﻿", "").replace("\r\n", "\n").replace("\r", "\n")
    body = "\n".join(_texts(text))
    if any(c in body for c in "ÂÃâ"):
        body = _BROKEN.sub(_repair, body)
    lines = _own_lines(body.split("\n"))
    for i, line in enumerate(lines):
        if _CLOSING.match(line.strip()) and any(x.strip() for x in lines[:i]):
            lines = lines[:i]
            break
    paragraphs = re.split(r"\n\s*\n", "\n".join(lines))
    kept = [p for p in paragraphs if not _disclaims(p) and not _POSTSCRIPT.match(p) and not _BRACKETED.match(p)]
    return "\n\n".join(kept).strip()
