"""Request URLs, paths, keys and hosts reduced to facts that hold no values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clausetrail import rules as R
from clausetrail.functions.idna import ascii_host
from clausetrail.functions.patterns import any_of, let, matches, text_list, trim_blanks

URL = r"(?i)^(https?)://(?:([^/?#@]*)@)?(\[[^\]/?#]*\]|[^/?#:@\s]+)(?::(\d{1,5}))?(/[^?#]*)?(?:\?([^#]*))?(?:#(.*))?$"


def url_part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, URL, group)


def url_groups(text: Column) -> Column:
    """The seven parts of a URL, or an array of another size; one match gives all of them, line by line."""
    every = F.array(*[url_part(text, i) for i in range(1, 8)])
    lines = F.split(F.regexp_replace(text, URL, "$1\n$2\n$3\n$4\n$5\n$6\n$7"), "\n")
    # A text with line ends of its own, which are rare, is taken apart group by group.
    return F.when(text.rlike("[\n\u0085]"), F.when(text.rlike(URL), every)).otherwise(lines)


def resolved_path(path: Column) -> Column:
    """The path without "." and ".." segments, also where their dots are percent-encoded."""
    segments = F.transform(F.split(path, "/"), lambda s: F.when(s.rlike(r"(?i)^(\.|%2e){1,2}$"), F.regexp_replace(s, "(?i)%2e", ".")).otherwise(s))

    def step(done: Column, segment: Column) -> Column:
        shorter = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))
        return F.when(segment == "..", shorter).when(segment == ".", done).otherwise(F.concat(done, F.array(segment)))

    def whole(s: Column) -> Column:
        kept = F.aggregate(F.slice(s, 2, F.size(s)), F.array(F.lit("")), step)
        # A dot segment at the end leaves a folder.
        return F.array_join(F.when(F.element_at(s, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/")

    return F.when(path.rlike(r"(?i)/(\.|%2e)"), let(segments, whole)).otherwise(path)


def parts(url: Column) -> Column:
    """(scheme, login, host, port, path, query, fragment) of an http(s) URL, or NULL.

    IPv4 hosts come in their dotted form, international names in ASCII; a host that ends in a number and is no
    address makes no URL.
    """

    def of_host(g: list[Column], host: Column) -> Column:
        scheme, port, path = F.lower(g[0]), g[3], g[4]
        usual = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
        return F.when(
            host.isNotNull(),
            F.struct(
                scheme.alias("scheme"),
                g[1].alias("login"),
                host.alias("host"),
                F.when(usual, F.lit("")).otherwise(port).alias("port"),
                F.when(path == "", F.lit("/")).otherwise(resolved_path(path)).alias("path"),
                g[5].alias("query"),
                g[6].alias("fragment"),
            ),
        )

    def plain_host(named: Column) -> Column:
        numeric = named.rlike(r"(^|\.)(0x[0-9a-f]*|[0-9]+)\.?$")
        return F.when(numeric, ipv4_of(F.regexp_replace(named, r"\.$", ""))).otherwise(named)

    def of_groups(g: Column) -> Column:
        found = [g[i] for i in range(7)]
        return F.when(F.size(g) == 7, let(let(ascii_host(found[2]), plain_host), lambda host: of_host(found, host)))

    return let(let(trim_blanks(url), url_groups), of_groups)


def authority(p: Column) -> Column:
    return F.concat(p["host"], F.when(p["port"] != "", F.concat(F.lit(":"), p["port"])).otherwise(F.lit("")))


def origin(p: Column) -> Column:
    return F.concat(p["scheme"], F.lit("://"), authority(p))


def decoded(text: Column) -> Column:
    """Percent-decoded text; malformed text stays as it is and '+' stays '+'."""
    plain = F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)
    return F.when(F.contains(text, F.lit("%")), plain).otherwise(text)


def query_pairs(query: Column) -> Column:
    """(key, value) structs of a query string, decoded, in order."""
    items = F.filter(F.split(query, "&"), lambda item: item != "")

    def pair(item: Column) -> Column:
        key = F.substring_index(item, "=", 1)
        value = F.when(F.contains(item, F.lit("=")), F.substring(item, F.length(key) + 2, F.length(item))).otherwise("")
        clean = lambda c: F.when(c.rlike("[%+]"), F.coalesce(F.try_url_decode(c), c)).otherwise(c)
        return F.struct(clean(key).alias("key"), clean(value).alias("value"))

    return F.transform(items, pair)


def path_segment(segment: Column) -> Column:
    """A path segment with identifiers and free words replaced by their kind."""

    def route(text: Column, word: Column, extension: Column) -> Column:
        stem = F.substring(word, F.lit(1), F.length(word) - F.when(extension != "", F.length(extension) + 1).otherwise(0))
        words = F.filter(F.split(stem, "[-_.]+"), lambda w: w != "")
        known = let(words, lambda w: (F.size(w) > 0) & F.forall(w, lambda x: x.isin(R.ROUTE_WORDS)))
        return (
            F.when(text == "", F.lit(""))
            .when((F.length(text) > 48) | F.contains(text, F.lit("@")) | matches(text, R.TOKEN_LIKE_PATH, False), F.lit(":redacted"))
            .when(text.rlike(r"^\d+\z"), F.lit(":id"))
            .when(word.rlike(r"^v\d{1,3}\z") | word.isin(R.LOCALE_SEGMENTS) | known, word)
            .when(matches(extension, R.STATIC_FILE, False), F.concat(F.lit(":file."), extension))
            .otherwise(F.lit(":segment"))
        )

    def by_word(text: Column) -> Column:
        word = F.substring(F.regexp_replace(F.lower(text), "[^a-z0-9._~-]", "-"), 1, 48)
        return let(word, lambda w: let(F.regexp_extract(w, r"\.([a-z0-9]{1,8})\z", 1), lambda e: route(text, w, e)))

    return let(trim_blanks(decoded(segment)), by_word)


def minimal_path(path: Column, segments: int = R.MAX_PATH_SEGMENTS, chars: int = R.MAX_PATH_CHARS) -> Column:
    parts_ = F.slice(F.filter(F.split(F.substring(path, 1, max(4096, chars * 8)), "/"), lambda s: s != ""), 1, segments)
    kept = F.filter(F.transform(parts_, path_segment), lambda s: s != "")
    return F.substring(F.concat(F.lit("/"), F.array_join(kept, "/")), 1, chars)


def _looks_random(text: Column) -> Column:
    """Long text that mixes letters, digits or cases the way generated tokens do."""

    def judge(bare: Column) -> Column:
        mixed = bare.rlike("[a-z]") & bare.rlike("[A-Z]")
        digits = F.length(F.regexp_replace(bare, "[^0-9]", ""))
        return (F.length(bare) >= 24) & (
            bare.rlike("(?i)^eyJ")
            | (
                bare.rlike("[A-Za-z]")
                & F.when(bare.rlike("[0-9]"), mixed | ((F.length(bare) >= 32) & (digits >= 4))).otherwise(mixed)
            )
        )

    return let(F.regexp_replace(text, "[_-]", ""), judge)


def _mask_run(run: Column) -> Column:
    """One run of letters, digits, '_' and '-': masked when it looks generated."""

    def mask(body: Column) -> Column:
        prefix = F.regexp_extract(body, "(?i)^([a-z]+)([_-])(.+)$", 1)
        rest = F.substring(body, F.length(prefix) + 2, F.length(body))
        known = F.lower(prefix).isin(R.IDENTIFIER_PREFIXES) & _looks_random(rest)
        kept = F.when(known, F.substring(body, F.lit(1), F.length(prefix) + 1)).otherwise(F.lit(""))
        return F.when(_looks_random(body), F.concat(F.regexp_extract(run, "^[_-]*", 0), kept, F.lit("__token__"))).otherwise(run)

    # Shorter runs are never masked.
    return F.when(F.length(run) < 24, run).otherwise(let(F.regexp_replace(run, "^[_-]+", ""), mask))


# A long hexadecimal run with a letter, and a digit or four different letters.
_HEX_RUN = (
    r"(?i)(?<![a-z0-9])(?=[0-9]*[a-f])(?=[a-f]*[0-9]|[a-f]*?([a-f])[a-f]*?(?!\1)([a-f])[a-f]*?(?!\1|\2)([a-f])"
    r"[a-f]*?(?!\1|\2|\3)[a-f])[a-f0-9]{16,}(?![a-z0-9])"
)


def tracking_family(name: Column) -> Column:
    """Family name of a tracking cookie, NULL for other names."""
    google = F.regexp_extract(name, r"(?i)^(_?(?:ga|gat|gac|gcl))_.+$", 1)
    named = F.regexp_extract(name, r"(?i)^(ajs|amplitude|mixpanel)_.+$", 1)
    return (
        F.when(matches(name, R.STATIC_TRACKING_COOKIE), F.lower(name))
        .when(google != "", F.concat(F.lower(google), F.lit("___identifier__")))
        .when(named != "", F.concat(F.lower(named), F.lit("___identifier__")))
        .when(name.rlike(r"(?i)^mp_.+_mixpanel$"), F.lit("mp___identifier___mixpanel"))
    )


def _security_prefix(value: Column) -> tuple[Column, Column]:
    prefix = F.regexp_extract(value, r"(?i)^(__(?:host|secure)-).+$", 1)
    name = F.substring(value, F.length(prefix) + 1, F.length(value))
    marked = F.startswith(value, F.lit("__"))
    return F.when(marked, prefix).otherwise(""), F.when(marked, name).otherwise(value)


def _words(text: Column, separators: str, vocabulary: list[str]) -> Column:
    """True when the text splits into at least one word and all are in the vocabulary."""
    words = F.filter(F.split(text, separators), lambda w: w != "")
    return let(words, lambda w: (F.size(w) > 0) & F.forall(w, lambda x: x.isin(vocabulary)))


def _mask_suffix(value: Column) -> Column:
    """``user_x1y2`` becomes ``user___identifier__`` unless the rest is ordinary words."""
    prefix, name = _security_prefix(value)
    pattern = r"(?i)^([a-z]+)([._-])(.+)$"
    head, mark, tail = (F.regexp_extract(name, pattern, g) for g in (1, 2, 3))
    masked = F.concat(prefix, head, mark, F.lit("__identifier__"))
    ordinary = _words(F.lower(tail), "[_-]+", R.IDENTIFIER_WORDS)
    return F.when(F.lower(head).isin(R.IDENTIFIER_PREFIXES) & ~ordinary, masked).otherwise(value)


_VOCABULARY = sorted(set(R.IDENTIFIER_WORDS) | set(R.IDENTIFIER_PREFIXES))


def _mask_unknown(value: Column) -> Column:
    """Names with a word outside the vocabulary keep only their hints."""
    prefix, name = _security_prefix(value)
    spaced = F.lower(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2"))
    hints = F.array_compact(F.array(*[F.when(matches(name, p), F.lit(h)) for p, h in R.IDENTIFIER_HINTS]))
    kept = (
        matches(name, R.STANDALONE_NAME)
        | name.rlike("__(?:hex|identifier|number|token|uuid)__")
        | _words(spaced, "[^a-z0-9]+", _VOCABULARY)
    )
    return F.when(kept, value).otherwise(F.concat(prefix, F.array_join(hints, "_"), F.lit("__identifier__")))


def _mask_parts(name: Column) -> Column:
    """Identifiers, tokens and long numbers inside a name, then its words."""
    masked = F.regexp_replace(name, "(?i)" + R.UUID_TEXT, "\u0001uuid\u0001")
    masked = F.regexp_replace(masked, _HEX_RUN, "\u0001hex\u0001")
    runs = F.split(masked, "(?<=[A-Za-z0-9_-])(?=[^A-Za-z0-9_-])|(?<=[^A-Za-z0-9_-])(?=[A-Za-z0-9_-])")
    # All of these have 16 characters or more.
    masked = F.when(F.length(name) < 16, name).otherwise(F.array_join(F.transform(runs, _mask_run), ""))
    masked = F.regexp_replace(masked, R.LONG_NUMBER, "__number__")
    masked = F.replace(masked, F.lit("\u0001uuid\u0001"), F.lit("__uuid__"))
    masked = F.replace(masked, F.lit("\u0001hex\u0001"), F.lit("__hex__"))
    return let(let(masked, _mask_suffix), _mask_unknown)


def masked_name(value: Column, chars: int = 256) -> Column:
    """A key or cookie name with embedded identifiers replaced by their kind."""

    def mask(name: Column) -> Column:
        # One ordinary word is the usual case and needs none of the tests.
        return (
            F.when((name == "") | name.isin(_VOCABULARY), name)
            .otherwise(F.substring(F.coalesce(tracking_family(name), _mask_parts(name)), 1, chars))
        )

    return let(trim_blanks(F.coalesce(value, F.lit(""))), mask)


def safe_key(masked: Column) -> Column:
    """True for masked keys that may be kept."""
    return (
        (masked != "")
        & (masked != "__identifier__")
        & (F.length(masked) <= R.MAX_FIELD_KEY_CHARS)
        & masked.rlike(r"^[\p{L}\p{N}_.\[\]-]+\z")
    )


def field_keys(keys: Column, most: int | None = None) -> Column:
    """Masked, distinct keys of one request; the first ``most`` where a limit is given."""
    masked = F.filter(F.transform(keys, lambda k: masked_name(k, 4096)), safe_key)
    distinct = F.array_distinct(masked)
    return F.slice(distinct, 1, most) if most else distinct


def sensitive_query(query: Column) -> Column:
    """True when a query holds a key that looks like a secret."""
    return F.exists(
        query_pairs(query),
        lambda p: matches(p["key"], R.SENSITIVE_QUERY_KEY)
        | matches(F.regexp_replace(F.lower(p["key"]), "[^a-z0-9]", ""), R.SENSITIVE_QUERY_COMPACT, False),
    )


def is_ipv4(host: Column) -> Column:
    octets = F.split(host, r"\.")
    shaped = host.rlike(r"^\d{1,3}(\.\d{1,3}){3}\z")
    return shaped & F.forall(octets, lambda o: F.coalesce(o.try_cast("int") <= 255, F.lit(False)))


def ipv4_of(host: Column) -> Column:
    """The dotted form of an IPv4 address in any notation of URLs, NULL for other hosts.

    One to four numbers, decimal, octal (leading 0) or hexadecimal (0x); the last fills the bytes left.
    """

    def number(part: Column) -> Column:
        octal = part.rlike("^0[0-7]+$")
        base16 = F.conv(F.substring(part, 3, 16), 16, 10).try_cast("bigint")
        value = F.when(part.rlike("^0x[0-9a-f]{1,12}$"), base16).when(part == "0x", F.lit(0))
        value = value.when(octal & (F.length(part) <= 14), F.conv(part, 8, 10).try_cast("bigint"))
        return value.when(part.rlike("^(0|[1-9][0-9]{0,11})$"), part.try_cast("bigint"))

    def dotted(numbers: Column) -> Column:
        n = F.size(numbers)
        last = F.element_at(numbers, -1)
        room = F.element_at(F.array(*[F.lit(256 ** (4 - i)) for i in range(4)]), n)
        heads = F.slice(numbers, 1, n - 1)
        fits = F.forall(heads, lambda x: x <= 255) & (last < room)
        shifted = F.aggregate(heads, F.lit(0).cast("bigint"), lambda total, x: total * 256 + x) * room + last
        parts_ = [F.shiftright(shifted, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)]
        return F.when(fits, F.concat_ws(".", *parts_))

    shaped = host.rlike(r"^(0x[0-9a-f]*|[0-9]+)(\.(0x[0-9a-f]*|[0-9]+)){0,3}$")
    numbers = F.transform(F.split(host, r"\."), number)
    return F.when(shaped & F.forall(numbers, lambda x: x.isNotNull()), let(numbers, dotted))


def _reserved(o: list[Column]) -> Column:
    """True for the first three numbers of an IPv4 address that isn't public."""
    return any_of(
        [
            o[0].isin(0, 10, 127),
            (o[0] == 100) & o[1].between(64, 127),
            (o[0] == 169) & (o[1] == 254),
            (o[0] == 172) & o[1].between(16, 31),
            (o[0] == 192) & (o[1] == 168),
            (o[0] == 192) & (o[1] == 0) & o[2].isin(0, 2),
            (o[0] == 198) & o[1].isin(18, 19),
            (o[0] == 198) & (o[1] == 51) & (o[2] == 100),
            (o[0] == 203) & (o[1] == 0) & (o[2] == 113),
            o[0] >= 224,
        ]
    )


# Beginnings of IPv6 addresses, as 32 hexadecimal digits, that are not public (unspecified,
# loopback, local, link, site, multicast, documentation, discard, benchmark, ORCHID, local translation,
# segment routing, Teredo), and where other ranges carry an IPv4 address.
IPV6_RESERVED = (
    "0{32}$|0{31}1$|f[cd]|fe[89ab]|fe[c-f]|ff|20010db8|3fff0|01000{12}|200100020000|2001001|2001002|0064ff9b0001|5f00|20010000"
)
IPV6_HOLDS_IPV4_LAST = "0{24}|0{20}ffff|0{16}ffff0000|0064ff9b0{16}|[0-9a-f]{16}0[02]005efe"
IPV6_HOLDS_IPV4_FIRST = "2002"


def ipv6_digits(host: Column) -> Column:
    """An IPv6 address, without brackets, as 32 hexadecimal digits; NULL when it is none."""
    dotted = F.regexp_extract(host, r"(?:^|:)(\d{1,3}(?:\.\d{1,3}){3})$", 1)
    numbers = F.transform(F.split(dotted, r"\."), lambda n: F.lpad(F.lower(F.hex(n.try_cast("bigint"))), 2, "0"))
    hexed = F.concat(F.array_join(F.slice(numbers, 1, 2), ""), F.lit(":"), F.array_join(F.slice(numbers, 3, 2), ""))
    before = F.substring(host, F.lit(1), F.length(host) - F.length(dotted))
    plain = F.when(dotted == "", host).when(is_ipv4(dotted), F.concat(before, hexed))

    def digits(text: Column) -> Column:
        sides = F.split(text, "::")
        groups = lambda side: F.filter(F.split(side, ":"), lambda g: g != "")
        left, right = groups(sides[0]), groups(F.coalesce(F.try_element_at(sides, F.lit(2)), F.lit("")))
        count = F.size(left) + F.size(right)
        full = F.when(F.size(sides) == 1, count == 8).otherwise((F.size(sides) == 2) & (count < 8))
        pad = lambda side: F.array_join(F.transform(side, lambda g: F.lpad(g, 4, "0")), "")
        zeros = F.repeat(F.lit("0000"), 8 - count)
        shaped = text.rlike(r"^([0-9a-f]{1,4}(:[0-9a-f]{1,4})*)?(::)?([0-9a-f]{1,4}(:[0-9a-f]{1,4})*)?$")
        return F.when(shaped & full, F.concat(pad(left), F.when(F.size(sides) == 2, zeros).otherwise(""), pad(right)))

    return let(plain, digits)


def _private_ipv6(host: Column) -> Column:
    def octets(digits: Column) -> list[Column]:
        return [F.conv(F.substring(digits, i, 2), 16, 10).cast("int") for i in (1, 3, 5)]

    def judge(digits: Column) -> Column:
        inside = F.when(digits.rlike(f"^(?:{IPV6_HOLDS_IPV4_LAST})"), _reserved(octets(F.substring(digits, 25, 8)))).when(
            digits.rlike(f"^(?:{IPV6_HOLDS_IPV4_FIRST})"), _reserved(octets(F.substring(digits, 5, 8)))
        )
        return digits.isNull() | digits.rlike(f"^(?:{IPV6_RESERVED})") | F.coalesce(inside, F.lit(False))

    return let(ipv6_digits(host), judge)


def private_host(host: Column) -> Column:
    """Hosts a public policy cannot live on: local names, single labels, reserved addresses."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(host), r"^\[|\]$", ""), r"\.\z", "")
    name = F.coalesce(ipv4_of(bare), bare)
    o = [F.coalesce(F.try_element_at(F.split(name, r"\."), F.lit(i)).try_cast("int"), F.lit(-1)) for i in (1, 2, 3)]
    address = F.contains(name, F.lit(":"))
    return (
        (name == "")
        | name.isin(R.PRIVATE_HOST_NAMES)
        | any_of([F.endswith(name, F.lit(s)) for s in R.PRIVATE_HOST_SUFFIXES])
        | (~F.contains(name, F.lit(".")) & ~address)
        | (address & F.coalesce(_private_ipv6(name), F.lit(True)))
        | (is_ipv4(name) & _reserved(o))
    )


def host_suffixes(host: Column) -> Column:
    """The host and each parent: a.b.c gives [a.b.c, b.c, c]."""
    labels = F.split(host, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )


def tracking_cookie(name: Column) -> Column:
    return matches(F.lower(F.coalesce(name, F.lit(""))), R.TRACKING_COOKIE, False)


def tracker_tokens(host: Column, path: Column) -> Column:
    """True when a host label or a path word is a general tracker word."""
    words = F.concat(F.split(host, r"\."), F.split(F.lower(path), "[^a-z0-9]+"))
    return F.arrays_overlap(words, text_list(R.TRACKER_TOKENS))


def fingerprint(url: Column) -> Column:
    """Opaque identity of a document URL: query-sensitive, blind to logins."""
    p = parts(url)
    query = F.when(p["query"] != "", F.concat(F.lit("?"), p["query"])).otherwise(F.lit(""))
    fragment = F.when(p["fragment"] != "", F.concat(F.lit("#"), p["fragment"])).otherwise(F.lit(""))
    return F.when(p.isNotNull(), F.sha2(F.concat(origin(p), p["path"], query, fragment), 256))


def canonical_policy_url(url: Column) -> Column:
    """The URL itself when it is a safe https policy address, else NULL."""
    p = parts(url)
    pairs = query_pairs(p["query"])
    keys = F.transform(pairs, lambda q: q["key"])

    def allowed(q: Column) -> Column:
        value = trim_blanks(q["value"])
        return q["key"].isin(R.SAFE_POLICY_QUERY) & F.when(
            q["key"].isin("hl", "lang", "locale"), matches(value, R.SAFE_LOCALE_VALUE)
        ).otherwise(matches(value, R.SAFE_VERSION_VALUE))

    ok = (
        (F.length(url) <= R.MAX_POLICY_URL_CHARS)
        & (p["scheme"] == "https")
        & (p["login"] == "")
        & (p["fragment"] == "")
        & F.forall(pairs, allowed)
        & (F.size(F.array_distinct(keys)) == F.size(keys))
        & (F.size(keys) <= 4)
    )
    query = F.when(p["query"] != "", F.concat(F.lit("?"), p["query"])).otherwise(F.lit(""))
    return F.when(ok, F.concat(origin(p), p["path"], query))


def country_of(host: Column) -> Column:
    """Country of a host by its last label, only where that label is a reliable sign."""
    last = F.element_at(F.split(F.btrim(F.lower(host), F.lit(".")), r"\."), -1)
    chain = F.lit(None).cast("string")
    for label, code in R.COUNTRY_TLDS.items():
        chain = F.when(last == label, F.lit(code)).otherwise(chain)
    return chain


def is_tracker(host: Column, path: Column) -> Column:
    """True for a known tracker domain or a tracker word in host or path; needs no join."""
    name = F.regexp_replace(host, r"\.+\z", "")
    return F.arrays_overlap(host_suffixes(name), text_list(R.TRACKER_DOMAINS)) | tracker_tokens(name, path)
