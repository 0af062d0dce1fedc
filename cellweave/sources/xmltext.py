"""XML parts whose names lose their prefixes, so that from_xml meets local names only. Text is left as it is."""

from __future__ import annotations

import re

_MARKUP = re.compile(r"<!\[CDATA\[.*?\]\]>|<!--.*?-->|<\?.*?\?>|<(/?)(?:[\w.-]+:)?([\w.-]+)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>", re.DOTALL)
_ATTRIBUTE = re.compile(r"([\w.-]+:)?([\w.-]+)\s*=\s*(\"[^\"]*\"|'[^']*')")


def bare_names(xml: str) -> str:
    """xml with local names only. Of attributes that become equal the first stays; declarations and comments go."""

    def one(m: re.Match) -> str:
        if m[2] is None:
            return m[0] if m[0].startswith("<![") else ""
        held: dict[str, str] = {}
        for prefix, name, value in _ATTRIBUTE.findall(m[3]):
            if prefix != "xmlns:" and name != "xmlns":
                held.setdefault(name, value)
        end = "/" if m[3].rstrip().endswith("/") else ""
        return f"<{m[1]}{m[2]}{''.join(f' {k}={v}' for k, v in held.items())}{end}>"

    return _MARKUP.sub(one, xml)
