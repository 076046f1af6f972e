"""HTML by tokens, as column expressions.

One alternation takes a page apart: comments, declarations, elements whose content is text (scripts, styles, titles and
so on) together with that content, and other tags. Values of attributes in quotes may hold ``>``. What is no token is
text. A tag that the page does not finish, or that has over ``ATTRIBUTES`` of them, swallows the rest.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space inside tags, and elements whose content is text up to their end tag.
_W = r" \n\r\t\f"
TEXT_ELEMENTS = ("iframe", "noembed", "noframes", "style", "textarea", "title", "xmp")
#: Loops that the pattern's engine runs by recursion: attributes of a tag, and comments with a script in one script.
ATTRIBUTES, HIDDEN = 500, 50
#: From a tag's name on to its end.
_REST = rf"""[^>=]*+(?:=[{_W}]*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^{_W}>]*+)[^>=]*+){{0,{ATTRIBUTES}}}+>"""
_AT = rf"(?=[{_W}/>])"
#: In a script, a comment that a script begins in hides that one's end tag.
_HIDES = rf"<!(?=--)(?:(?!-->|</?script[{_W}/>]).)*+<script{_AT}"
_DOUBLE = rf"{_HIDES}.*?(?:</script{_AT}|(?=-->)|\z)(?:(?:(?!-->|</?script[{_W}/>]).)*+<script{_AT}.*?(?:</script{_AT}|(?=-->)|\z)){{0,{HIDDEN}}}+"
_PLAIN = rf"(?>.*?(?={_HIDES}|</script[{_W}/>]|\z))"
_SCRIPT = rf"{_PLAIN}(?:{_DOUBLE}{_PLAIN}){{0,{HIDDEN}}}+"
_HEAD = rf"(?is)\A<[a-z][^{_W}/>]*+{_REST}"
_TOKEN = (
    rf"(?is)<!--(?:>|->|.*?(?:--!?>|\z))|<script{_AT}{_REST}{_SCRIPT}(?:</script{_AT}{_REST})?"
    rf"|<({'|'.join(TEXT_ELEMENTS)}){_AT}{_REST}.*?(?=</\1[{_W}/>]|\z)|<plaintext{_AT}{_REST}.*"
    rf"|</?[a-z][^{_W}/>]*+{_REST}|<[!?][^>]*+>?|</[^a-z][^>]*+>?|</?[a-z].*"
)
_ATTRIBUTE = rf"""(?s)[^{_W}/>=][^{_W}/>=]*+(?:[{_W}]*+=[{_W}]*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^{_W}>]*+))?"""
# The named character references that every page may use.
_NAMED = (("&quot;", '"'), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", "\u00a0"), ("&amp;", "&"))


def tokens(html: Column) -> Column:
    """The tokens of a page in order, each as its text."""
    return F.regexp_extract_all(html, F.lit(_TOKEN), F.lit(0))


def _unescaped(value: Column) -> Column:
    """Character references by number below 2^16, and the commonest by name; others stay as they are."""
    pieces = F.split(value, r"(?i)&#(?:x[0-9a-f]{1,4}|[0-9]{1,5});", -1)
    codes = F.regexp_extract_all(value, F.lit(r"(?i)&#(x[0-9a-f]{1,4}|[0-9]{1,5});"), F.lit(1))
    number = lambda c: F.when(F.lower(F.left(c, F.lit(1))) == "x", F.conv(F.substr(c, F.lit(2)), 16, 10)).otherwise(c).cast("int")
    # two bytes each, as UTF-16 text
    letter = lambda c: F.decode(F.unhex(F.lpad(F.hex(number(c)), 4, "0")), "UTF-16BE")
    numbered = F.concat(F.element_at(pieces, 1), F.array_join(F.zip_with(F.slice(pieces, F.lit(2), F.size(codes)), codes, lambda p, c: F.concat(letter(c), p)), ""))
    out = F.when(value.contains("&#"), numbered).otherwise(value)
    for name, text in _NAMED:
        out = F.replace(out, F.lit(name), F.lit(text))
    return out


def _lines(text: Column) -> Column:
    """Line ends as line feeds."""
    return F.regexp_replace(text, "\r\n?", "\n")


def parsed(token: Column) -> Column:
    """Of a start tag: name, attributes (name, value) in order, whether it closes itself, its text, and whether that has an end tag.

    Names are in lower case. Only scripts have a text here.
    """
    head = F.regexp_extract(token, _HEAD, 0)
    name = F.lower(F.regexp_extract(head, rf"(?is)\A<([^{_W}/>]+)", 1))
    rest = F.substr(head, F.length(name) + 2, F.length(head) - F.length(name) - 2)
    given = F.regexp_extract_all(rest, F.lit(_ATTRIBUTE), F.lit(0))
    value = lambda a: F.regexp_extract(a, rf"(?s)\A[^=]*+=[{_W}]*+(.*)\z", 1)
    bare = lambda v: F.when(v.rlike(r"""(?s)\A(?:".*"|'.*')\z"""), F.substr(v, F.lit(2), F.length(v) - 2)).otherwise(v)
    pair = lambda a: F.struct(F.lower(F.regexp_extract(a, rf"\A[^{_W}=]+", 0)).alias("name"), _lines(_unescaped(bare(value(a)))).alias("value"))
    tail = F.substr(token, F.length(head) + 1)
    closed = rf"(?is)\A({_SCRIPT})</script{_AT}{_REST}\z"
    return F.struct(
        name.alias("name"), F.transform(given, pair).alias("attributes"), head.endswith("/>").alias("closes_itself"),
        _lines(F.regexp_extract(tail, closed, 1)).alias("text"), tail.rlike(closed).alias("ended"),
    )


def tags(html: Column, *names: str) -> Column:
    """The start tags of a page with one of the ``names``, ``parsed``, in order."""
    wanted = F.filter(tokens(html), lambda t: t.rlike(rf"(?i)\A<(?:{'|'.join(names)})[{_W}/>]"))
    return F.filter(F.transform(wanted, parsed), lambda t: t["name"] != "")


def attribute(tag: Column, name: str) -> Column:
    """The value of a tag's last attribute of a name (empty: without a value); null without it."""
    return F.get(F.reverse(F.transform(F.filter(tag["attributes"], lambda a: a["name"] == name), lambda a: a["value"])), F.lit(0))
