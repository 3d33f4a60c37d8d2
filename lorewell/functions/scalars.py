"""Scalar functions as Catalyst expressions."""

from __future__ import annotations

from ipaddress import ip_network
from posixpath import normpath
from re import escape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Languages and their file extensions; a smaller table for fenced code blocks.
LANGUAGES = {
    "go": [".go"], "typescript": [".ts", ".tsx"], "javascript": [".js", ".jsx", ".mjs", ".cjs"], "python": [".py"], "markdown": [".md", ".markdown"],
    "rust": [".rs"], "java": [".java"], "c": [".c", ".h"], "cpp": [".cpp", ".cc", ".cxx", ".hpp"], "json": [".json"], "yaml": [".yaml", ".yml"],
    "sql": [".sql"], "bash": [".sh", ".bash"], "html": [".html", ".htm"], "css": [".css"],
}
FENCES = {
    "go": [".go"], "typescript": [".ts", ".tsx"], "javascript": [".js", ".jsx"], "python": [".py"], "rust": [".rs"], "java": [".java"], "c": [".c", ".h"],
    "cpp": [".cpp", ".hpp", ".cc"], "sql": [".sql"], "yaml": [".yaml", ".yml"], "json": [".json"], "markdown": [".md"], "bash": [".sh", ".bash"],
}
# Folders and endings that aren't indexed.
IGNORED_FOLDERS = [".git", ".github", "node_modules", "vendor", "dist", "build", ".next", "target", "__pycache__", ".venv"]
IGNORED_ENDINGS = [
    ".lock", "-lock.json", "-lock.yaml", ".lock.yaml", ".lockb", ".sum", ".exe", ".bin", ".zip", ".tar", ".gz", ".png", ".jpg", ".jpeg", ".gif", ".ico", ".svg",
    ".woff", ".woff2", ".ttf", ".pdf", ".pyc", ".wasm", ".so", ".dylib", ".dll", ".class", ".jar", ".war", ".db", ".sqlite", ".sqlite3", ".o", ".a", ".7z", ".rar",
]
# Words and phrases that mark a column as sensitive.
SENSITIVE_WORDS = [
    "password", "passwd", "pwd", "passphrase", "passcode", "secret", "token", "apikey", "salt", "ssn", "cvv", "cvc", "pin", "privkey", "credential",
    "credentials", "otp", "jwt", "bearer", "creditcard", "cardnumber",
]
SENSITIVE_PHRASES = [
    "password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "access_token", "refresh_token", "auth_token", "auth_key", "auth_secret", "salt",
    "ssn", "social_security", "credit_card", "creditcard", "card_number", "card_num", "cc_num", "cvv", "cvc", "pin", "passcode", "private_key", "privkey",
    "passphrase", "credential", "otp", "national_id",
]
# Openings of lines at which a chunk may end, by language.
BOUNDARIES = {
    "go": ["func ", "type ", "const ", "var "], "python": ["def ", "class ", "@"],
    "typescript": ["export ", "function ", "class ", "const ", "interface ", "type "], "markdown": ["#", "---"], "": ["func ", "def ", "class ", "#"],
}
LANGUAGE_NAMES = {"py": "python", "md": "markdown", "ts": "typescript", "js": "typescript", "tsx": "typescript", "jsx": "typescript", "javascript": "typescript"}
# IPv4 ranges that aren't public.
BLOCKED = [
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.88.99.0/24",
    "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4", "255.255.255.255/32",
]


def estimate_tokens(text: Column) -> Column:
    """floor(words * 1.3), at least 1 if there is any text."""
    n = F.floor(F.regexp_count(text, F.lit(r"(?U)\S+")) * F.lit(1.3)).cast("int")
    return F.when(F.length(text) == 0, 0).otherwise(F.greatest(n, F.lit(1)))


def content_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def normalize_newlines(text: Column) -> Column:
    """CRLF and CR become LF; one final LF goes."""
    return F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), r"\n\z", "")


def non_blank(text: Column) -> Column:
    return F.regexp_like(text, F.lit(r"(?U)\S"))


def is_binary(content: Column) -> Column:
    """A NUL byte among the first 8000."""
    return F.contains(F.substring(content.cast("binary"), 1, 8000), F.unhex(F.lit("00")))


def _extension(path: Column) -> Column:
    return F.regexp_extract(F.lower(path), r"(\.[^./]*)$", 1)


def _by_extension(path: Column, table: dict[str, list[str]], other: str) -> Column:
    known = F.create_map(*[F.lit(x) for name, ends in table.items() for end in ends for x in (end, name)])
    return F.coalesce(F.element_at(known, _extension(path)), F.lit(other))


def detect_language(path: Column) -> Column:
    return _by_extension(path, LANGUAGES, "text")


def detect_language_fence(path: Column) -> Column:
    return _by_extension(path, FENCES, "")


def upload_language(path: Column) -> Column:
    """Language of an upload; null for an extension that isn't taken."""
    ext = _extension(path)
    return F.when(ext.isin(".md", ".markdown"), "markdown").when(ext == ".json", "json").when(ext == ".csv", "csv").when(ext == ".txt", "text")


def boundary_name(language: str | None) -> str:
    name = (language or "").lower()
    name = LANGUAGE_NAMES.get(name, name)
    return name if name in BOUNDARIES else ""


def has_boundaries(language: Column, name: str) -> Column:
    """Whether a language in lower case has the boundaries of this name."""
    return language.isin(name, *[k for k, v in LANGUAGE_NAMES.items() if v == name])


def is_boundary(line: Column, language: Column) -> Column:
    """A blank line, or one that opens a part in its language."""
    line = F.regexp_replace(line, r"(?U)^\s+", "")
    lang = F.lower(F.coalesce(language, F.lit("")))
    opens = lambda name: F.exists(F.array(*map(F.lit, BOUNDARIES[name])), lambda p: F.startswith(line, p))
    named = F.lit(None).cast("boolean")
    for name in [n for n in BOUNDARIES if n]:
        named = F.coalesce(F.when(has_boundaries(lang, name), opens(name)), named)
    return (line == "") | F.coalesce(named, opens(""))


def pr_state(merged_at: Column, state: Column, draft: Column) -> Column:
    state = issue_state(state)
    return F.when(merged_at.isNotNull(), "merged").when(state == "closed", "closed").when(draft, "draft").otherwise(state)


def issue_state(state: Column) -> Column:
    return F.coalesce(F.nullif(F.lower(F.trim(state)), F.lit("")), F.lit("open"))


def repo_slug(owner: Column, name: Column) -> Column:
    """owner/repo from two columns, or from a name or URL that ends in both; null otherwise."""
    both = F.regexp_extract(F.trim(name), r"^(?:(?:https?://)?github\.com/)?([^/\s]+/[^/\s#]+)$", 1)
    own = F.nullif(F.trim(owner), F.lit(""))
    return F.when(own.isNotNull() & (F.trim(name) != ""), F.concat(own, F.lit("/"), F.trim(name))).otherwise(F.nullif(both, F.lit("")))


def push_branch(ref: Column) -> Column:
    return F.regexp_replace(ref, "^refs/heads/", "")


def table_kind(kind: Column) -> Column:
    return F.when(F.lower(kind).contains("view"), "view").otherwise("table")


def vector_literal(vector: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(vector.cast("array<string>"), ","), F.lit("]"))


def markdown_cell(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(value, F.lit("|"), F.lit("\\|")), "\r\n|\n|\r", " "))


def url_is_safe(url: Column) -> Column:
    """http or https to a host that is neither internal by name nor a literal IPv4 address of a closed range. Literal IPv6
    addresses, and hosts of digits and dots (or hexadecimal numbers) that aren't four octets, are refused: resolvers read them as addresses in ways of their own. A dot at the end of
    a host changes nothing. No lookup."""
    host = F.lower(F.regexp_extract(F.trim(url), r"(?i)^https?://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]+)", 1))
    host = F.regexp_replace(host, r"\.+$", "")
    inner = host.isin("localhost", "localhost.localdomain", "metadata", "metadata.google.internal") | host.rlike(r"\.(local|internal|localhost)$")
    four = host.rlike(r"^(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(\.(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}$")
    odd = host.startswith("[") | ~four & host.rlike(r"^(0x[0-9a-f]*|\d+)(\.(0x[0-9a-f]*|\d+))*$")
    octets = F.transform(F.split(F.when(four, host), r"\."), lambda x: x.cast("long"))
    ip = F.aggregate(octets, F.lit(0).cast("long"), lambda a, x: a * 256 + x)
    closed = F.lit(False)
    for net in map(ip_network, BLOCKED):
        closed = closed | ip.between(int(net[0]), int(net[-1]))
    return F.coalesce(host != "", F.lit(False)) & ~inner & ~odd & ~F.coalesce(closed, F.lit(False))


def glob_pattern(glob: str) -> str | None:
    """A glob as a regular expression: * and ? stay within a folder, [a-z] and [^a-z] are classes, a backslash takes the
    next character as it is. None where it is malformed: then it matches nothing."""
    out, i, n = [], 0, len(glob)

    def one(i: int) -> tuple[str, int]:
        if glob[i] == "\\":
            i += 1
        if i >= n:
            raise ValueError
        return glob[i], i + 1

    try:
        while i < n:
            c = glob[i]
            if c in "*?":
                out.append("[^/]*" if c == "*" else "[^/]")
                i += 1
            elif c == "[":
                i += 1
                negated = i < n and glob[i] == "^"
                i += negated
                ranges = []
                while i >= n or glob[i] != "]" or not ranges:
                    if i >= n or glob[i] in "-]":
                        return None
                    low, i = one(i)
                    high = low
                    if i < n and glob[i] == "-":
                        if i + 1 >= n or glob[i + 1] in "-]":
                            return None
                        high, i = one(i + 1)
                    ranges.append(f"\\x{{{ord(low):x}}}-\\x{{{ord(high):x}}}" if low <= high else "")
                i += 1
                held = "".join(ranges)
                out.append(f"[^/{held}]" if negated else f"[{held}&&[^/]]" if held else "(?!)")
            else:
                c, i = one(i)
                out.append(escape(c))
    except ValueError:
        return None
    return "(?s)^" + "".join(out) + "$"


def compiled_filter(text: str) -> tuple[str, str | None, list[str]]:
    """(exact path, pattern of the glob, beginnings) of a file filter."""
    clean = normpath(text)
    under = clean.removesuffix("/*").removesuffix("/**").removesuffix("*")
    return clean, glob_pattern(text), [under, under.removeprefix("/")] if under else []


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("exact", T.StringType()), T.StructField("glob", T.StringType()), T.StructField("under", T.ArrayType(T.StringType()))])))
def compiled_filters(filters: pd.Series) -> pd.Series:
    """A column of filter lists, compiled once a row; null where there is none."""
    made = lambda row: None if row is None or not len(row) else [dict(zip(("exact", "glob", "under"), compiled_filter(f), strict=True)) for f in row if f is not None]
    return filters.map(made)


def path_matches(path: Column, compiled: Column) -> Column:
    """Whether a path meets one of the filters of compiled_filters(): it equals one, matches it as a glob by itself or by its
    last part, or lies under it. No filters, and rows without a path, pass."""
    last = F.regexp_extract(path, "([^/]*)/*$", 1)

    def met(f: Column) -> Column:
        glob = F.coalesce(F.rlike(path, f["glob"]) | F.rlike(last, f["glob"]), F.lit(False))
        return (path == f["exact"]) | glob | F.exists(f["under"], lambda u: F.startswith(path, u))

    return compiled.isNull() | F.coalesce(path == "", F.lit(True)) | F.exists(compiled, met)


def file_filter(path: Column, filters: list[str]) -> Column:
    """As path_matches(), with one list of filters for all rows; an empty list lets no path through but a missing one."""
    met, last = F.lit(False), F.regexp_extract(path, "([^/]*)/*$", 1)
    for exact, glob, under in map(compiled_filter, filters):
        met = met | (path == exact)
        if glob:
            met = met | path.rlike(glob) | last.rlike(glob)
        for u in under:
            met = met | F.startswith(path, F.lit(u))
    return F.coalesce(path == "", F.lit(True)) | met


def slugify_title(title: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    s = F.regexp_replace(F.left(s, F.lit(50)), "-+$", "")
    return F.when(s == "", "untitled").otherwise(s)


def safe_filename(path: Column) -> Column:
    s = F.regexp_extract(path, "([^/]+)/*$", 1)
    return F.when(~s.isin("", ".", ".."), s)


def clean_markdown(text: Column) -> Column:
    lines = F.regexp_replace(F.regexp_replace(text, "[ \t]+(?=\n)", ""), "\n{3,}", "\n\n")
    return F.regexp_replace(lines, r"\A[ \t\n]+|[ \t\n]+\z", "")


def title_from_url(url: Column) -> Column:
    path = F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)
    last = F.regexp_replace(F.regexp_extract(path, "([^/]+)/*$", 1), r"\.[^.]*$", "")
    return F.when(last != "", last).otherwise(F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#:]*)", 1))


def title_from_text(text: Column, url: Column) -> Column:
    """The first line that isn't blank: a heading without its mark, else what whole characters fit 80 bytes with '...' after; without such a
    line the title of the URL."""
    first = F.get(F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != ""), 0)
    cut = F.concat(F.regexp_replace(F.make_valid_utf8(F.substring(first.cast("binary"), 1, 80).cast("string")), "\uFFFD$", ""), F.lit("..."))
    heading = F.regexp_replace(F.substring(first, 3, 1 << 30), r"(?U)^\s+|\s+$", "")
    return F.coalesce(F.when(F.startswith(first, F.lit("# ")), heading).when(F.octet_length(first) > 80, cut).otherwise(first), title_from_url(url))


# Entities that titles hold; &amp; comes last, as it opens the others.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#39;": "'", "&#x27;": "'", "&#34;": '"', "&nbsp;": " ", "&ndash;": "–", "&mdash;": "—", "&hellip;": "…", "&copy;": "©", "&amp;": "&"}


def html_title(html: Column) -> Column:
    """The text of the first title, its entities resolved and its white space collapsed."""
    title = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    for name, value in ENTITIES.items():
        title = F.replace(title, F.lit(name), F.lit(value))
    return F.trim(F.regexp_replace(title, r"\s+", " "))


# Media types that are read; every other text/ type is as well.
MEDIA_TYPES = ["text/html", "application/xhtml+xml", "text/plain", "text/markdown", "text/x-markdown", "text/csv", "text/tab-separated-values", "application/json", "text/xml", "application/xml"]


def content_type_supported(content_type: Column) -> Column:
    """Whether the media type before any parameters is taken; null is not."""
    kind = F.lower(F.trim(F.substring_index(content_type, ";", 1)))
    return F.coalesce(kind.isin(MEDIA_TYPES) | F.startswith(kind, F.lit("text/")), F.lit(False))


def redact_credentials(text: Column) -> Column:
    """Passwords in URLs, and values after known keys up to white space, ; or &, are masked. A key may end a longer name."""
    s = F.regexp_replace(text, r"://([^:/\s@]+):([^@/\s]+)@", "://$1:******@")
    return F.regexp_replace(s, r"(?i)(password|passwd|pwd|secret|token|api_?key)\s*([=:])\s*([^;\s&]+)", "$1$2******")


def encrypt_column(text: Column, key: Column) -> Column:
    """AES-GCM with a nonce of its own for each value, as base64; the key has 16, 24 or 32 bytes."""
    return F.base64(F.aes_encrypt(text, key, F.lit("GCM")))


def decrypt_column(text: Column, key: Column) -> Column:
    return F.aes_decrypt(F.unbase64(text), key, F.lit("GCM")).cast("string")


def job_progress(done: Column, total: Column, start: int = 20, share: int = 75) -> Column:
    """Percent of a job whose work proper takes `share` of it; a job without files is at its start."""
    return F.when(total > 0, start + F.floor(done / total * share)).otherwise(start).cast("int")


def chunk_key(id_: Column, path: Column, start: Column, end: Column, content_hash: Column, content: Column) -> Column:
    """By what rankings know a chunk: its id, else path:start:end, else its hash, else its content, else its path."""
    some = lambda c: F.nullif(c.cast("string"), F.lit(""))
    return F.coalesce(some(id_), F.when((start > 0) | (end > 0), F.concat_ws(":", some(path), start, end)), some(content_hash), some(content), some(path))


def is_sensitive_column(name: Column) -> Column:
    low = F.lower(F.trim(name))
    writer = low.rlike("^authors?$|^authors?_|_authors?$|^authority$")
    words = F.split(F.lower(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2")), r"[_\-. ]")
    parts = "|".join(dict.fromkeys(p.replace("_", "") for p in SENSITIVE_PHRASES))
    return (low != "") & ~writer & (F.arrays_overlap(words, F.array(*map(F.lit, SENSITIVE_WORDS))) | F.regexp_replace(low, "[_-]", "").rlike(parts))


def should_index(path: Column, size: Column) -> Column:
    p = F.regexp_replace(path, "^/", "")
    folders, ends = ("|".join(map(escape, x)) for x in (IGNORED_FOLDERS, IGNORED_ENDINGS))
    return (size <= 1 << 20) & ~p.rlike(f"(^|/)({folders})/") & ~F.lower(p).rlike(f"({ends})$")


def dot_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def vector_norm(a: Column) -> Column:
    """Length of a vector. Stored beside it, each pair costs one product instead of three."""
    return F.sqrt(dot_product(a, a))


def cosine_similarity(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """0 where the dimensions differ or a vector is empty or zero. Norms that are known can be given."""
    size = (vector_norm(a) if norm_a is None else norm_a) * (vector_norm(b) if norm_b is None else norm_b)
    return F.when((F.size(a) != F.size(b)) | (size == 0), 0.0).otherwise(dot_product(a, b) / size)


def query_terms(query: Column) -> Column:
    found = F.regexp_extract_all(F.lower(query), F.lit("[a-z0-9_]+"), 0)
    return F.when(F.size(found) > 0, found).otherwise(F.filter(F.split(F.lower(query), r"\s+"), lambda x: x != ""))


def lexical_score(query: Column, content: Column, path: Column) -> Column:
    """10 for the whole query (over 3 bytes), c/(c+2) for each term's c occurrences, 1.5 for each term in the path, and
    3 times the share of terms that occur."""
    held = F.struct(F.lower(content).alias("text"), F.lower(path).alias("way"), query_terms(query).alias("terms"), F.lower(query).alias("q"))
    return F.get(F.transform(F.array(held), _lexical), 0)


def _lexical(x: Column) -> Column:
    text, way, terms, q = x["text"], x["way"], x["terms"], x["q"]
    whole = F.when((F.octet_length(q) > 3) & F.contains(text, q), 10.0).otherwise(0.0)

    def count(t: Column) -> Column:
        c = ((F.length(text) - F.length(F.replace(text, t, F.lit("")))) / F.length(t)).cast("double")
        use = F.octet_length(t) >= 2
        return F.struct(F.when(use, c).otherwise(0.0).alias("c"), (use & F.contains(way, t)).alias("w"))

    def step(a: Column, e: Column) -> Column:
        return F.struct((a["s"] + e["c"] / (e["c"] + 2) + F.when(e["w"], 1.5).otherwise(0.0)).alias("s"), (a["m"] + F.when(e["c"] > 0, 1).otherwise(0)).alias("m"))

    total = lambda a: a["s"] + F.when(a["m"] > 0, 3.0 * a["m"] / F.size(terms)).otherwise(0.0)
    return whole + F.aggregate(F.transform(terms, count), F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("m")), step, total)
