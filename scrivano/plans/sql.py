"""SQL for the registered queries, in DuckDB's dialect."""

from __future__ import annotations

import html

from scrivano import constants as C
from scrivano.operators import fingerprint
from scrivano.operators import rules as R
from scrivano.plans import fixtures

PY = C.PY_WS
JS = C.JS_WS
q = fixtures.quoted
FIX = f"fix(doc_id, text) AS ({fixtures.values(fixtures.FIX)})"
CORPUS = f"{FIX}, c AS (SELECT doc_id, text, source AS bucket FROM documents UNION ALL SELECT doc_id::BIGINT, text, 'fix' FROM fix)"
DOUBLED = f"{FIX}, c AS (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS text, source AS bucket FROM documents UNION ALL SELECT doc_id::BIGINT, replace(text, chr(10), chr(10) || chr(10)), 'fix' FROM fix)"


def found(t: str, pattern: str) -> str:
    return f"regexp_extract_all({t}, {q(pattern)})"


def count(t: str, pattern: str, flags: str = "") -> str:
    return f"len(regexp_extract_all({t}, {q((f'(?{flags})' if flags else '') + pattern)}))"


def among(tokens: str, names: list[str]) -> str:
    return f"len(list_filter({tokens}, lambda w: w IN ({', '.join(map(q, names))})))"


def trim(t: str, ws: str = JS) -> str:
    return f"regexp_replace({t}, {q(f'^[{ws}]+|[{ws}]+$')}, '', 'g')"


def words(t: str) -> str:
    return found(t, C.WORD)


def sentences(t: str) -> str:
    blank = q(f"\\n[{JS}]*\\n")
    return f"list_filter(list_transform(string_split_regex(replace(regexp_replace({t}, {blank}, '¶', 'g'), chr(10), ' '), '[.!?¶]+'), lambda x: {trim('x')}), lambda x: length(x) > 0)"


def register_sentences(t: str) -> str:
    return f"list_filter(string_split_regex({t}, '[.!?\\n]+'), lambda x: length({trim('x')}) > 0)"


def paragraphs(t: str) -> str:
    return f"list_filter(string_split_regex({t}, {q(f'\\n[{JS}]*\\n')}), lambda x: length({trim('x')}) > 0)"


def py_count(t: str) -> str:
    return count(t, f"[^{PY}]+")


def occurrences(t: str, part: str) -> str:
    return f"((length({t}) - length(replace({t}, {q(part)}, ''))) // {len(part)})::BIGINT"


def splitlines(t: str) -> str:
    parts = f"string_split_regex({t}, {q(C.LINE_END)})"
    return f"(CASE WHEN {parts}[-1] = '' THEN {parts}[:-2] ELSE {parts} END)"


FIRST_LOWER = "(left(s, 1) = lower(left(s, 1)) AND left(s, 1) <> upper(left(s, 1)))"
ASCII_CONTRACTION = r"\b\w+'(?:s|t|re|ve|ll|d|m)\b"
SENTENCES = f"e AS (SELECT *, len({words('s')}) AS n, {FIRST_LOWER} AS lower, lower({words('s')}[1]) AS opener FROM (SELECT bucket, doc_id, unnest(range(len(x))) AS pos, unnest(x) AS s FROM (SELECT bucket, doc_id, {sentences('text')} AS x FROM c)) WHERE len({words('s')}) > 0)"
LENGTHS = "(count(*))::BIGINT AS sentences, sum(n)::DOUBLE / count(*) AS mean, median(n)::DOUBLE AS p50, list_sort(list(n))[CAST(floor(count(*) * 0.9::DOUBLE) AS INT)]::BIGINT AS p90"
TOTALS = (
    "t AS (SELECT bucket, count(*)::BIGINT AS messages, greatest(sum(n), 1)::BIGINT AS words, sum(letters)::BIGINT AS letters, sum(allcaps)::BIGINT AS allcaps, sum(emoji)::BIGINT AS emoji, sum(contractions)::BIGINT AS contractions, sum(ellipses)::BIGINT AS ellipses, "
    + ", ".join(f"sum(p{i})::BIGINT AS p{i}" for i in range(len(C.PUNCTUATION)))
    + f" FROM (SELECT bucket, len(w) AS n, list_sum(list_transform(w, lambda x: length(lower(x)))) AS letters, len(list_filter(w, lambda x: length(x) > 2 AND x <> lower(x) AND x = upper(x))) AS allcaps, {count('text', C.EMOJI)} AS emoji, {count('text', ASCII_CONTRACTION, 'i')} AS contractions, {count('text', C.ELLIPSIS)} AS ellipses, "
    + ", ".join(f"{occurrences('text', p)} AS p{i}" for i, p in enumerate(C.PUNCTUATION))
    + f" FROM (SELECT bucket, text, {words('text')} AS w FROM c)) GROUP BY 1)"
)
STRIP = f"s AS (SELECT *, {py_count('stripped')}::BIGINT AS words FROM (SELECT doc_id, bucket, text, {trim('''regexp_replace(array_to_string(list_filter(''' + splitlines(f"regexp_replace(regexp_replace(text, {q(C.FENCE)}, ' ', 'g'), {q(C.IMAGE)}, ' ', 'g')") + f''', lambda x: NOT regexp_matches(x, {q(C.LOG_LINE)}) AND NOT regexp_matches(x, {q(C.LONG_TOKEN)})), chr(10)), '[ \\t]+', ' ', 'g')''', PY)} AS stripped FROM c))"


def route(t: str, n: str) -> str:
    return f"""CASE WHEN {n} = 0 THEN 'dropped' WHEN left({t}, 1) IN ('{{', '[') AND {occurrences(t, '":')} >= 2 THEN 'dropped' WHEN contains({t}, '—') THEN 'ai-marked' WHEN {n} <= {C.MAX_TYPED_WORDS} THEN 'curated' ELSE 'quarantine' END"""


def lang(t: str) -> str:
    greek, latin, w = count(t, C.GREEK_LETTER), count(t, "[a-zA-Z]"), found(f"lower({t})", C.LATIN_WORD)
    strong, weak = among(w, C.STRONG_GREEK), among(w, C.WEAK_GREEK)
    return f"CASE WHEN {greek} > {latin} THEN 'el' WHEN {latin} = 0 THEN 'other' WHEN len({w}) >= 4 AND {strong} >= 1 AND ({strong} + {weak})::DOUBLE / greatest(len({w}), 1) >= 0.12::DOUBLE THEN 'gr-latn' ELSE 'en' END"


# Look-around isn't known here: padding and doubling what isn't a word character leaves a consuming border for each match.
PADDED = r"' ' || regexp_replace(text, '([^\p{L}\p{N}_])', '\1\1', 'g') || ' '"
INSTRUCTION = C.INSTRUCTION.replace("let'?s", "let(?:'')?s").replace(" ", "  ")
SCORES = (
    f"x AS (SELECT doc_id, {found('lower(text)', C.REGISTER_WORD)} AS w, {register_sentences('text')} AS s, len(regexp_extract_all({PADDED}, {q('(?i)[^\\p{L}\\p{N}_](?:' + INSTRUCTION + ')[^\\p{L}\\p{N}_]')})) AS ins FROM c), "
    f"y AS (SELECT doc_id, len(w) AS n, len(s) AS parts, {among('w', C.TECH_NOUNS)} / greatest(len(w), 1)::DOUBLE AS tech, ins / greatest(len(s), 1)::DOUBLE AS ins, {among('list_distinct(list_transform(s, lambda z: ' + found('lower(z)', C.REGISTER_WORD) + '[1]))', C.IMPERATIVES)} / greatest(len(s), 1)::DOUBLE AS imp, {among('w', C.CASUAL)} / greatest(len(w), 1)::DOUBLE AS cas, {among('w', C.DISCOURSE)} / greatest(len(w), 1)::DOUBLE AS dis FROM x), "
    "z AS (SELECT doc_id, CASE WHEN n = 0 THEN 0::DOUBLE ELSE tech * 6::DOUBLE + ins * 1.5::DOUBLE + imp * 2::DOUBLE END AS technical, CASE WHEN n = 0 THEN 0::DOUBLE ELSE cas * 8::DOUBLE + CASE WHEN n < 8 THEN 0.3::DOUBLE ELSE 0::DOUBLE END END AS informal, "
    "CASE WHEN n = 0 THEN 0::DOUBLE ELSE greatest(dis * 5::DOUBLE + CASE WHEN parts >= 4 THEN 0.4::DOUBLE ELSE 0::DOUBLE END + CASE WHEN n > 80 THEN 0.3::DOUBLE ELSE 0::DOUBLE END - tech * 4::DOUBLE - ins * 1::DOUBLE - imp * 1.5::DOUBLE, 0::DOUBLE) END AS editorial FROM y)"
)
LABEL = "CASE WHEN greatest(a, b, e) <= 0 OR a = greatest(a, b, e) THEN 'technical-instruction' WHEN b = greatest(a, b, e) THEN 'informal' ELSE 'editorial' END"
LABELS = f"l AS (SELECT doc_id, {LABEL} AS register FROM (SELECT doc_id, floor(technical * 1e6) AS a, floor(informal * 1e6) AS b, floor(editorial * 1e6) AS e FROM z))"
KEPT = f"(SELECT doc_id, t FROM (SELECT doc_id, {trim(f'''regexp_replace(text, {q(C.PASTE)}, '', 'g')''')} AS t FROM c))"
DROPPED = "(t IN ('', '+') OR starts_with(t, '/') OR starts_with(t, 'Caveat:') OR starts_with(t, '[Request interrupted') OR starts_with(t, '<') AND contains(t, '>'))"


def rule_chain(flags: bool) -> str:
    """The rules without borders in look-around: this engine's \\b is ASCII and its \\s is written out."""
    t, columns = "text", []
    for r in R.RULES:
        p = r.pattern.replace(r"[\w\s]", rf"[\w{JS}]").replace(r"\s", f"[{JS}]")
        if r.kind == "flag":
            if flags and r.id != "contrast-flip":
                columns.append(f"{count(t, p, 'i')}::BIGINT AS {r.id.replace('-', '_')}")
        else:
            if not flags:
                columns.append(f"{count(t, p)}::BIGINT AS {r.id.replace('-', '_')}")
            t = f"regexp_replace({t}, {q(p)}, '', 'g')"
    return ", ".join(columns) if columns else t


def enforced() -> str:
    t = "text"
    for r in R.RULES:
        if r.kind != "flag":
            t = f"regexp_replace({t}, {q(r.pattern.replace(r'\s', f'[{JS}]'))}, '', 'g')"
    return f"regexp_replace({t}, '[ \\t]{{2,}}', ' ', 'g')"


def metrics(drafts: str) -> str:
    return (
        f"m AS (SELECT doc_id, k::BIGINT AS n_words, coalesce(list_sort(list_transform(s, lambda x: len({words('x')})))[len(s) // 2 + 1], 0)::BIGINT AS sent_p50, {occurrences('text', '—')} * 1000::DOUBLE / k AS emdash_per_1k, {occurrences('text', ',')} * 1000::DOUBLE / k AS comma_per_1k, {occurrences('text', '!')} * 1000::DOUBLE / k AS excl_per_1k, {count('text', ASCII_CONTRACTION, 'i')} * 1000::DOUBLE / k AS contractions_per_1k, "
        f"len(list_filter(s, lambda s: {FIRST_LOWER})) / greatest(len(s), 1)::DOUBLE AS lower_start_rate, text FROM (SELECT doc_id, text, greatest(len({words('text')}), 1) AS k, {sentences('text')} AS s FROM ({drafts})))"
    )


DRAFTS = "SELECT item_id AS doc_id, text FROM benchmark UNION ALL SELECT doc_id::BIGINT, text FROM fix"
BY_LANG = "c AS (SELECT doc_id, text, lang AS bucket FROM documents)"


def signals() -> str:
    t, parts = "text", []
    for r in R.RULES:
        p = r.pattern.replace(r"[\w\s]", rf"[\w{JS}]").replace(r"\s", f"[{JS}]")
        parts.append(count(t, p, "i" if r.kind == "flag" else ""))
        if r.kind != "flag":
            t = f"regexp_replace({t}, {q(p)}, '', 'g')"
    return "(" + " + ".join(parts) + ")::BIGINT"


REF = {"emdash_per_1k": "0::DOUBLE", "comma_per_1k": "t.p1 * 1000::DOUBLE / t.words", "excl_per_1k": "t.p4 * 1000::DOUBLE / t.words", "contractions_per_1k": "t.contractions * 1000::DOUBLE / t.words", "sent_p50": "u.p50", "lower_start_rate": "u.lower_starts / u.sentences::DOUBLE"}
PROFILES = f"{BY_LANG}, {SENTENCES}, {TOTALS}, u AS (SELECT bucket, {LENGTHS}, sum(lower::INT)::BIGINT AS lower_starts FROM e GROUP BY 1), r AS (SELECT t.bucket AS register, t.words, {', '.join(f'{v} AS ref_{k}' for k, v in REF.items())} FROM t JOIN u USING (bucket))"
_WEIGHT = " + ".join(f"{w}::DOUBLE * {'damp' if noisy else '1'}" for _, _, w, noisy in C.METRICS)
_PENALTY = " + ".join(f"least(abs({n} - ref_{n}) / {s}::DOUBLE, 1::DOUBLE) * {w}::DOUBLE * {'damp' if noisy else '1'}" for n, s, w, noisy in C.METRICS)
FIDELITY = f"greatest(0::DOUBLE, (1 - ({_PENALTY}) / ({_WEIGHT})) * (1 - least(signals * 0.06::DOUBLE, 0.4::DOUBLE))) * 100"
SCORED = f"{PROFILES}, {FIX}, {metrics(DRAFTS + ' WHERE doc_id > -14')}, f AS (SELECT doc_id, register, n_words, signals, {FIDELITY} AS fidelity FROM (SELECT *, least(1::DOUBLE, n_words / 250::DOUBLE) AS damp, {signals()} AS signals FROM m), r)"

TYPO = f"g AS (SELECT lang AS bucket, w, count(*)::BIGINT AS n FROM (SELECT lang, unnest({found('text', C.TYPO_TOKEN)}) AS w FROM documents) GROUP BY 1, 2), d AS (SELECT DISTINCT w FROM g WHERE n >= 20)"
_PROBES = ["w"] + [f"CASE WHEN suffix(w, {q(s)}) THEN left(w, length(w) - {len(s)}) END" for s in C.SUFFIXES] + ["CASE WHEN suffix(w, 'ing') THEN left(w, length(w) - 3) || 'e' END", "CASE WHEN suffix(w, 'ed') THEN left(w, length(w) - 1) END"]
_LETTERS = "[" + ", ".join(map(q, C.EDIT_LETTERS)) + "]"
_EDITS = (
    "list_transform(range(length(w)), lambda i: left(w, i) || substr(w, i + 2))",
    "list_transform(range(length(w) - 1), lambda i: left(w, i) || substr(w, i + 2, 1) || substr(w, i + 1, 1) || substr(w, i + 3))",
    f"flatten(list_transform(range(length(w)), lambda i: list_transform({_LETTERS}, lambda c: left(w, i) || c || substr(w, i + 2))))",
    f"flatten(list_transform(range(length(w) + 1), lambda i: list_transform({_LETTERS}, lambda c: left(w, i) || c || substr(w, i + 1))))",
)
CATALOG = (
    f"{TYPO}, rare AS (SELECT * FROM g WHERE n <= 2 AND NOT contains(w, '''') AND NOT EXISTS (SELECT 1 FROM (SELECT w AS k, unnest([{', '.join(_PROBES)}]) AS form FROM (SELECT DISTINCT w FROM g WHERE n <= 2)) p JOIN d ON d.w = p.form WHERE p.k = g.w)), "
    f"forms AS (SELECT bucket, w, n, unnest(f) AS form, unnest(range(len(f))) AS pos FROM (SELECT bucket, w, n, list_concat(list_concat({_EDITS[0]}, {_EDITS[1]}), list_concat({_EDITS[2]}, {_EDITS[3]})) AS f FROM rare)), "
    "k AS (SELECT forms.bucket, forms.w AS typo, arg_min(form, pos) AS correction, forms.n FROM forms JOIN g ON g.bucket = forms.bucket AND g.w = form JOIN d ON d.w = form WHERE g.n >= greatest(3 * forms.n, 3) GROUP BY 1, 2, 4)"
)
FLAVOR = f"{py_count('p')} BETWEEN 4 AND most AND NOT regexp_matches(p, {q(C.CORRESPONDENCE)}) AND NOT regexp_matches(p, {q(C.DOCUMENT_LIKE)}) AND regexp_matches(' ' || p || ' ', {q('(?i)[^\\p{L}\\p{N}_](?:' + C.SALVAGE_INSTRUCTION + ')[^\\p{L}\\p{N}_]')})"


def flavored(p: str, most: int) -> str:
    return "coalesce(" + FLAVOR.replace("most", str(most)).replace("regexp_matches(p,", f"regexp_matches({p},").replace("|| p ||", f"|| {p} ||").replace("regexp_extract_all(p,", f"regexp_extract_all({p},") + ", false)"


SALVAGE = (
    f"{DOUBLED}, {STRIP}, qu AS (SELECT doc_id, list_transform({paragraphs('text')}, lambda x: {trim('x')}) AS ps FROM (SELECT doc_id, text, {route('text', py_count('text'))} AS route FROM c) WHERE route = 'quarantine'), "
    f"fl AS (SELECT *, {flavored('ps[1]', 120)} AS one, {flavored('ps[2]', 120)} AS two_, {flavored('ps[-1]', 60)} AS fin FROM qu WHERE len(ps) >= 2), "
    "o AS (SELECT doc_id, array_to_string(list_filter([CASE WHEN one THEN ps[1] END, CASE WHEN one AND two_ THEN ps[2] END, CASE WHEN fin AND len(ps) > one::INT + (one AND two_)::INT THEN ps[-1] END], lambda x: x IS NOT NULL), chr(10) || chr(10)) AS text FROM fl) "
    f"SELECT min(doc_id) AS doc_id, text, {py_count('text')}::BIGINT AS words FROM o WHERE NOT contains(text, '—') AND {py_count('text')} >= 8 AND text NOT IN (SELECT stripped FROM s WHERE {route('stripped', 'words')} = 'curated') GROUP BY text"
)
TURNS = f"u AS (SELECT conv_id, turn, text, {py_count('text')}::BIGINT AS words FROM conversations WHERE role = 'user')"
KEPT_TURNS = f"{TURNS}, c AS (SELECT conv_id AS doc_id, turn, text FROM u), k AS (SELECT doc_id AS conv_id, turn, t FROM (SELECT doc_id, turn, {trim(f'''regexp_replace(text, {q(C.PASTE)}, '', 'g')''')} AS t FROM c) WHERE NOT {DROPPED})"
EMAIL_CLEAN = f"""SELECT doc_id, {trim(f'''regexp_replace(regexp_replace(regexp_replace(array_to_string(list_filter(coalesce(ls[:cut - 1], ls), lambda x: NOT starts_with(regexp_replace(x, {q(f'^[{PY}]+')}, ''), '>')), chr(10)), {q(C.URL)}, ' ', 'g'), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')''', PY)} AS text FROM (SELECT doc_id, ls, list_position(list_transform(ls, lambda x: regexp_matches(x, {q(C.QUOTE_INTRO.replace('(?iu)', '(?i)'))}) OR regexp_matches(x, {q(C.OUTLOOK_DIVIDER)})), true) AS cut FROM (SELECT doc_id, {splitlines("split_part(text, chr(10) || '-- ' || chr(10), 1)")} AS ls FROM c))"""


def with_(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


MARKUP = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<style.*?</style>', ' ', 'g'), '(?is)<script.*?</script>', ' ', 'g'), {q(f'(?i)<br[{JS}]*/?>|</p>|</div>')}, chr(10), 'g'), '<[^>]+>', ' ', 'g')"


def unescaped(t: str) -> str:
    """Named references decoded, & last; pages have no numeric ones."""
    names = [n for n in C.ENTITIES if n != "amp"] + ["amp"]
    for n in names:
        t = f"replace({t}, {q(f'&{n};')}, {q(html.unescape(f'&{n};'))})"
    return t


LANG_SPLIT_OF_C = (
    f"""SELECT doc_id, chunk, lang, text FROM (WITH p AS (SELECT doc_id, text, pos, para, {lang('para')} AS lang, {py_count('para')} AS n FROM (SELECT doc_id, text, unnest(range(len(ps))) AS pos, unnest(ps) AS para FROM (SELECT doc_id, text, CASE WHEN len({paragraphs('text')}) = 0 THEN [text] ELSE {paragraphs('text')} END AS ps FROM c))),
    tot AS (SELECT doc_id, lang, sum(n) AS total, min(pos) AS first FROM p GROUP BY 1, 2), rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY total DESC, first) AS place FROM tot),
    sd AS (SELECT doc_id, max(CASE WHEN place = 1 THEN lang END) AS major, coalesce(max(CASE WHEN place = 2 THEN total END), 0) AS second FROM rk GROUP BY 1),
    tg AS (SELECT p.*, major, second, CASE WHEN p.lang <> lag(p.lang) OVER (PARTITION BY doc_id ORDER BY pos) THEN 1 ELSE 0 END AS new FROM p JOIN sd USING (doc_id)),
    isl AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS chunk FROM tg)
    SELECT doc_id, 0::BIGINT AS chunk, major AS lang, text FROM isl WHERE second < 15 AND pos = 0 UNION ALL SELECT doc_id, chunk::BIGINT, lang, string_agg(para, chr(10) || chr(10) ORDER BY pos) FROM isl WHERE second >= 15 GROUP BY doc_id, chunk, lang)""")
LANG_SPLIT = with_(DOUBLED) + LANG_SPLIT_OF_C


SQL: dict[str, str] = {
    "fp_basic": with_(CORPUS, SENTENCES, TOTALS) + f"SELECT t.bucket, t.messages, t.words, m.p AS message_len_p50, x.sentences, x.mean, x.p50, x.p90 FROM t JOIN (SELECT bucket, {LENGTHS} FROM e GROUP BY 1) x USING (bucket) JOIN (SELECT bucket, median(len({words('text')}))::DOUBLE AS p FROM c GROUP BY 1) m USING (bucket)",
    "fp_punct": with_(CORPUS, TOTALS) + "SELECT bucket, words, " + ", ".join(f"p{i}" for i in range(len(C.PUNCTUATION))) + " FROM t",
    "fp_case": with_(CORPUS, SENTENCES, TOTALS) + "SELECT t.bucket, t.allcaps, count(*)::BIGINT AS sentences, sum(e.lower::INT)::BIGINT AS lower_starts FROM t JOIN e USING (bucket) GROUP BY 1, 2",
    "fp_rates": with_(CORPUS, TOTALS) + "SELECT bucket, emoji, contractions, ellipses, words FROM t",
    "fp_lexical": with_(CORPUS, TOTALS) + f"SELECT t.bucket, letters, words, v.u AS unique_words, letters / words::DOUBLE AS avg_word_len, v.u / words::DOUBLE AS unique_word_ratio FROM t JOIN (SELECT bucket, count(DISTINCT w)::BIGINT AS u FROM (SELECT bucket, unnest(list_transform({words('text')}, lambda x: lower(x))) AS w FROM c) GROUP BY 1) v USING (bucket)",
    "fp_openers": with_(CORPUS, SENTENCES) + "SELECT bucket, rank, n, opener FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY n DESC, d, pos) AS rank FROM (SELECT bucket, opener, count(*)::BIGINT AS n, min((doc_id, pos)) AS f, f[1] AS d, f[2] AS pos FROM e GROUP BY 1, 2)) WHERE rank <= 15",
    "fp_connectors": with_(CORPUS) + f"SELECT bucket, rank, n, w AS connector FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY n DESC, list_position([{', '.join(map(q, C.CONNECTORS))}], w)) AS rank FROM (SELECT bucket, w, count(*)::BIGINT AS n FROM (SELECT bucket, unnest(list_transform({words('text')}, lambda x: lower(x))) AS w FROM c) WHERE w IN ({', '.join(map(q, C.CONNECTORS))}) GROUP BY 1, 2)) WHERE rank <= 12",
    "rhythm_only": with_(CORPUS, SENTENCES, TOTALS) + f"SELECT t.bucket || '-rhythm' AS bucket, messages, words, mean, p50, p90, allcaps, emoji, ellipses FROM t JOIN (SELECT bucket, {LENGTHS} FROM e GROUP BY 1) USING (bucket) WHERE bucket IN (SELECT bucket FROM c GROUP BY 1 HAVING sum({py_count('text')}) >= {fingerprint.RHYTHM_WORDS})",
    "words_tokens": with_(CORPUS) + f"SELECT doc_id, len({words('text')})::BIGINT AS words, {count('text', C.TYPO_TOKEN)}::BIGINT AS typo_tokens, {count('lower(text)', C.LATIN_WORD)}::BIGINT AS latin_words, {count('lower(text)', C.REGISTER_WORD)}::BIGINT AS register_words, len({sentences('text')})::BIGINT AS sentences, len({register_sentences('text')})::BIGINT AS register_sentences, {py_count('text')}::BIGINT AS py_words, len({splitlines('text')})::BIGINT AS lines FROM c",
    "curate_strip": with_(CORPUS, STRIP) + "SELECT doc_id, stripped FROM s",
    "curate_routes": with_(CORPUS, STRIP) + f"SELECT doc_id, {route('stripped', 'words')} AS route, {py_count('text')}::BIGINT AS raw_words, words FROM s",
    "route_totals": with_(CORPUS, STRIP) + f"SELECT {route('stripped', 'words')} AS route, count(*)::BIGINT AS messages, sum(words)::BIGINT AS words FROM s GROUP BY 1",
    "curate_stats": with_(CORPUS, STRIP) + f"""SELECT unnest(range(6))::BIGINT AS at, unnest(['# Curated corpus stats', '', 'Kept: ' || count(*) FILTER (r = 'curated') || ' messages, ' || coalesce(sum(words) FILTER (r = 'curated'), 0)::BIGINT || ' words', 'Quarantined (over {C.MAX_TYPED_WORDS} words): ' || count(*) FILTER (r = 'quarantine') || ' messages, ' || coalesce(sum(words) FILTER (r = 'quarantine'), 0)::BIGINT || ' words', 'AI-marked: ' || count(*) FILTER (r = 'ai-marked') || ' messages', 'Dropped: ' || count(*) FILTER (r = 'dropped')]) AS line FROM (SELECT words, {route('stripped', 'words')} AS r FROM s)""",
    "extract_stats": with_(KEPT_TURNS) + f"""SELECT 0::BIGINT AS part, unnest(range(7))::BIGINT AS at, unnest(['# Corpus stats', '', 'Messages: ' || count(*) || ', words: ' || coalesce(sum(words), 0)::BIGINT || ', duplicates skipped: ' || (SELECT count(*) FROM k) - count(*), 'Range: t' || (SELECT lpad(min(turn)::VARCHAR, 6, '0') FROM k) || ' to t' || (SELECT lpad(max(turn)::VARCHAR, 6, '0') FROM k), '', '| project | messages | words |', '|---|---|---|']) AS line FROM (SELECT t, min({py_count('t')}) AS words FROM k GROUP BY 1)
    UNION ALL SELECT 1::BIGINT, row_number() OVER (ORDER BY n DESC, f)::BIGINT, '| ' || conv_id || ' | ' || n || ' | ' || w || ' |' FROM (SELECT conv_id, count(*) AS n, sum({py_count('t')})::BIGINT AS w, min((conv_id, turn)) AS f FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY conv_id, turn) AS m FROM k) WHERE m = 1 GROUP BY 1)""",
    "keep_messages": with_(CORPUS) + f"SELECT doc_id, CASE WHEN NOT {DROPPED} THEN t END AS kept FROM {KEPT}",
    "dedupe_first": with_(CORPUS) + "SELECT doc_id, bucket FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM c) WHERE n = 1",
    "duplicate_counts": with_(CORPUS) + "SELECT min(doc_id) AS first_doc_id, count(*)::BIGINT AS n FROM c GROUP BY text HAVING count(*) > 1",
    "length_bands": with_(CORPUS) + f"SELECT band, position::BIGINT AS position, count(n)::BIGINT AS messages FROM (VALUES ('1-5', 0), ('6-20', 1), ('21-50', 2), ('51+', 3)) b(band, position) LEFT JOIN (SELECT CASE WHEN n <= 5 THEN '1-5' WHEN n <= 20 THEN '6-20' WHEN n <= 50 THEN '21-50' ELSE '51+' END AS band, n FROM (SELECT {py_count('text')} AS n FROM c)) USING (band) GROUP BY 1, 2",
    "project_totals": with_(TURNS) + "SELECT conv_id::VARCHAR AS project, count(*)::BIGINT AS messages, sum(words)::BIGINT AS words FROM u GROUP BY 1",
    "extract_turns": with_(KEPT_TURNS) + f"SELECT conv_id::VARCHAR AS project, turn AS line_no, {py_count('t')}::BIGINT AS words, t AS text FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY conv_id, turn) AS n FROM k) WHERE n = 1",
    "extract_summary": with_(KEPT_TURNS) + "SELECT count(DISTINCT t)::BIGINT AS messages, (count(*) - count(DISTINCT t))::BIGINT AS duplicates, count(DISTINCT conv_id)::BIGINT AS projects, 't' || lpad(min(turn)::VARCHAR, 6, '0') AS first_ts, 't' || lpad(max(turn)::VARCHAR, 6, '0') AS last_ts FROM k",
    "lang_detect": with_(CORPUS) + f"SELECT doc_id, {lang('text')} AS lang FROM c",
    "lang_split": LANG_SPLIT,
    "tag_scores": with_(CORPUS, SCORES) + "SELECT doc_id, technical, informal, editorial FROM z",
    "tag_register": with_(CORPUS, SCORES, LABELS) + "SELECT doc_id, register FROM l",
    "tagged_messages": with_(CORPUS, SCORES) + f"SELECT doc_id, a AS technical, b AS informal, e AS editorial, {LABEL} AS register FROM (SELECT doc_id, round_even(technical, 3) AS a, round_even(informal, 3) AS b, round_even(editorial, 3) AS e FROM z)",
    "tag_distribution": with_(CORPUS, SCORES, LABELS) + f"SELECT register, count(*)::BIGINT AS messages, sum({py_count('text')})::BIGINT AS words, count(*) * 100::DOUBLE / sum(count(*)) OVER () AS share FROM l JOIN c USING (doc_id) GROUP BY 1",
    "salvage_fragments": "WITH " + SALVAGE,
    "owner_threads": "SELECT role AS sender, count(DISTINCT conv_id)::BIGINT AS threads FROM conversations GROUP BY 1 ORDER BY 2 DESC, min((conv_id, turn)) LIMIT 1",
    "owner_mailbox": "SELECT source, address, n FROM (SELECT source, lang AS address, count(*)::BIGINT AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, min(doc_id)) AS r FROM documents GROUP BY 1, 2) WHERE r = 1",
    "demojibake": with_(CORPUS) + "SELECT doc_id, unnest(['broken', 'sound']) AS kind, text FROM c WHERE doc_id <> -12",
    "url_strip": with_(CORPUS) + f"SELECT doc_id, regexp_replace(text, {q(C.URL)}, ' ', 'g') AS text FROM c",
    "html_text": f"SELECT page_id, {MARKUP} AS text FROM pages",
    "html_unescaped": f"SELECT page_id, {unescaped(MARKUP)} AS text FROM pages",
    "ingest_counters": f"WITH doc AS (SELECT doc_id, source, lang = first_value(lang) OVER (PARTITION BY source ORDER BY n DESC, f) AS own, text FROM (SELECT *, count(*) OVER (PARTITION BY source, lang) AS n, min(doc_id) OVER (PARTITION BY source, lang) AS f FROM documents)), parts AS ({LANG_SPLIT}) SELECT (SELECT count(*) FROM parts JOIN doc USING (doc_id) WHERE own AND {py_count('doc.text')} >= 5 AND {py_count('parts.text')} >= 5)::BIGINT AS kept, ((SELECT count(*) FROM doc WHERE own AND {py_count('text')} < 5) + (SELECT count(*) FROM parts JOIN doc USING (doc_id) WHERE own AND {py_count('doc.text')} >= 5 AND {py_count('parts.text')} < 5))::BIGINT AS skipped, (SELECT count(*) FROM doc WHERE NOT own)::BIGINT AS not_owner",
    "email_clean": with_(CORPUS) + EMAIL_CLEAN,
    "bounce_filter": with_(CORPUS) + "SELECT doc_id FROM c WHERE doc_id % 7 <> 0",
    "email_date": "SELECT * FROM (VALUES (-1::BIGINT, 'Thu, 04 Jun 2026 09:05:00 +0000'), (-2, '31 Feb 2026 10:00 +0000'), (-3, 'Wed, 01 Jan 1969 10:00:00 +0000'), (-4, 'Wed, 01 Jan 2068 10:00:00 -0500'), (-5, 'yesterday'), (-6, 'Mon, 02 Jan 2023 10:00:00 +0200')) t(doc_id, ts)".replace("'Wed, 01 Jan 2068", "'Sun, 01 Jan 2068"),
    "from_addr": f"WITH m(doc_id, sender, sent) AS ({fixtures.values(fixtures.MAILS)}) SELECT doc_id::BIGINT AS doc_id, trim(CASE WHEN contains(sender, '<') THEN regexp_replace(string_split(lower(sender), '<')[-1], '>+$', '') ELSE lower(sender) END) AS address FROM m",
    "email_year_buckets": "SELECT bucket, count(*)::BIGINT AS messages FROM (SELECT unnest(list_filter([b, CASE WHEN y < 2023 THEN b || '-pre2023' END, CASE WHEN y >= 2024 THEN b || '-recent' END], lambda x: x IS NOT NULL)) AS bucket FROM (SELECT 'email-' || source AS b, 2019 + doc_id % 8 AS y FROM documents)) GROUP BY 1",
    "bucket_union": "WITH b AS (SELECT lang, source, 2021 + doc_id % 4 AS y FROM documents), x AS (SELECT lang, unnest(list_filter([k, CASE WHEN y < 2023 THEN k || '-pre2023' END, CASE WHEN y >= 2024 THEN k || '-recent' END], lambda z: z IS NOT NULL)) AS bucket FROM (SELECT lang, y, unnest(['email-' || source, 'chat-' || source]) AS k FROM b)) SELECT pool, bucket, count(*)::BIGINT AS messages FROM (SELECT 'words' AS pool, lang AS bucket FROM b UNION ALL SELECT 'words', bucket FROM x WHERE lang <> 'de' UNION ALL SELECT 'rhythm', bucket FROM x WHERE lang = 'de' AND starts_with(bucket, 'chat-')) GROUP BY 1, 2",
    "rules_flags": with_(CORPUS) + f"SELECT doc_id, {rule_chain(True)} FROM c",
    "rules_applied": with_(CORPUS) + f"SELECT doc_id, {rule_chain(False)} FROM c",
    "enforce_text": with_(CORPUS) + f"SELECT doc_id, {enforced()} AS enforced FROM c",
    "rules_list": "SELECT id, kind, position::BIGINT AS position, tests::BIGINT AS tests FROM (VALUES " + ", ".join(f"({q(r.id)}, {q(r.kind)}, {i}, {len(r.tests)})" for i, r in enumerate(R.RULES)) + ") t(id, kind, position, tests)",
    "text_metrics": with_(FIX, metrics(DRAFTS)) + "SELECT doc_id, n_words, sent_p50, emdash_per_1k, comma_per_1k, excl_per_1k, contractions_per_1k, lower_start_rate FROM m",
    "fidelity": with_(SCORED) + "SELECT doc_id, round(fidelity * 1e6) / 1e6 AS fidelity, CASE WHEN n_words >= 250 THEN 'ok' ELSE 'low' END AS confidence, signals FROM f WHERE register = 'en'",
    "infer_register": with_(SCORED) + "SELECT doc_id, register, round(fidelity * 1e6) / 1e6 AS score, round(margin * 1e6) / 1e6 AS margin, CASE WHEN margin >= 15 THEN 'high' ELSE 'low' END AS confidence FROM (SELECT *, fidelity - coalesce(lead(fidelity) OVER w, 0) AS margin, row_number() OVER w AS n FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY fidelity DESC, register DESC)) WHERE n = 1",
    "registers_info": with_(PROFILES) + "SELECT register, words::BIGINT AS words, CASE WHEN words >= 30000 THEN 'high' WHEN words >= 8000 THEN 'medium' ELSE 'low' END AS confidence FROM (SELECT register, words FROM r UNION ALL VALUES ('thin', 10), ('some', 9000))",
    "typo_catalog": with_(CATALOG) + "SELECT bucket, typo, correction, n FROM k",
    "typo_rates": with_(CATALOG, BY_LANG, TOTALS) + "SELECT t.bucket, coalesce(s.n, 0) * 1000::DOUBLE / t.words AS typo_per_1k FROM t LEFT JOIN (SELECT bucket, sum(n)::BIGINT AS n FROM k GROUP BY 1) s USING (bucket)",
    "feedback_counts": "SELECT *, bad >= 3 AND bad > good AS due FROM (SELECT source AS register, count(*) FILTER (v = 'good')::BIGINT AS good, count(*) FILTER (v = 'fine')::BIGINT AS fine, count(*) FILTER (v = 'bad')::BIGINT AS bad FROM (SELECT source, CASE WHEN toxic = 1 THEN 'bad' WHEN quality = 1 THEN 'good' WHEN doc_id % 5 = 0 THEN 'odd' ELSE 'fine' END AS v FROM labels JOIN documents USING (doc_id)) WHERE v <> 'odd' GROUP BY 1)",
    "blind_candidates": f"SELECT doc_id FROM documents WHERE source = 'src1' AND {py_count('text')} BETWEEN 25 AND 120",
    "generated_snippets": with_(DOUBLED) + f"SELECT text FROM (SELECT {trim('p')} AS text FROM (SELECT unnest({paragraphs('text')}) AS p FROM c)) WHERE {py_count('text')} >= 15",
    "blind_sample": with_(CORPUS) + f"SELECT left(text, 400) AS text, truth FROM (SELECT text, 'author' AS truth, row_number() OVER (ORDER BY md5('3:' || text), text) AS n FROM c WHERE {py_count('text')} BETWEEN 25 AND 120 UNION ALL SELECT text, 'model', row_number() OVER (ORDER BY md5('4:' || text), text) FROM (SELECT {trim('p')} AS text FROM (SELECT unnest({paragraphs('text')}) AS p FROM benchmark)) WHERE {py_count('text')} >= 15) WHERE n <= 5",
    "blind_rate": "SELECT count(*)::BIGINT AS n, sum((quality = toxic)::INT)::DOUBLE / count(*) AS rate FROM labels",
    "words_by_language": with_(CORPUS) + f"SELECT {lang('text')} AS lang, sum({py_count('text')})::BIGINT AS words FROM c GROUP BY 1",
    "source_names": "SELECT * FROM (VALUES ('facebook-ann-2024.zip', 'facebook'), ('Instagram_x', 'instagram'), ('my.export.zip', 'my.export'), ('WhatsApp', 'whatsapp')) t(name, source)",
    "project_names": "SELECT * FROM (VALUES ('-home-ann-projects-tool', 'tool'), ('plain', 'plain'), ('-a-projects-b-projects-c', 'c')) t(folder, project)",
    "round_half_even": "SELECT doc_id, round_even((doc_id % 100) / 2.0::DOUBLE, 0)::DOUBLE AS rounded FROM documents",
    "transcript_files": with_(KEPT_TURNS) + f"SELECT 'project=p' || conv_id % 10 AS project, {py_count('t')}::BIGINT AS words, t AS text, 't' || turn AS ts FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY conv_id % 10, conv_id, turn) AS n FROM k) WHERE n = 1",
    "mailbox_files": f"WITH doc AS (SELECT doc_id, source, lang = first_value(lang) OVER (PARTITION BY source ORDER BY n DESC, f) AS own, text FROM (SELECT *, count(*) OVER (PARTITION BY source, lang) AS n, min(doc_id) OVER (PARTITION BY source, lang) AS f FROM documents WHERE text IS NOT NULL)), clean AS (WITH c AS (SELECT doc_id, regexp_replace(text, '(^|\\n)From ', '\\1>From ', 'g') AS text FROM doc WHERE own) {EMAIL_CLEAN}), c AS (SELECT doc_id, text FROM clean WHERE {py_count('text')} >= 5) SELECT source, 'Thu, 04 Jun 2026 09:05:00 +0000' AS ts, parts.lang, {py_count('parts.text')}::BIGINT AS words, parts.text FROM ({LANG_SPLIT_OF_C}) parts JOIN doc USING (doc_id) WHERE {py_count('parts.text')} >= 5",
    "route_files": with_(CORPUS, STRIP) + f"SELECT route, bucket AS project, count(*)::BIGINT AS messages, sum(raw)::BIGINT AS raw_words, sum(words)::BIGINT AS words FROM (SELECT bucket, words, {py_count('text')} AS raw, {route('stripped', 'words')} AS route FROM s) WHERE route <> 'dropped' GROUP BY 1, 2",
    "profile_files": with_(CORPUS, SENTENCES, TOTALS) + f"SELECT t.bucket, t.messages, t.words, m.p AS message_len_p50, o.n AS openers, x.p50 AS ref_sent_p50 FROM t JOIN (SELECT bucket, {LENGTHS} FROM e GROUP BY 1) x USING (bucket) JOIN (SELECT bucket, median(len({words('text')}))::DOUBLE AS p FROM c GROUP BY 1) m USING (bucket) JOIN (SELECT bucket, least(15, count(DISTINCT opener))::BIGINT AS n FROM e GROUP BY 1) o USING (bucket)",
    "feedback_file": "SELECT *, bad >= 3 AND bad > good AS due, 500::BIGINT AS longest_note FROM (SELECT 'r' || doc_id % 4 AS register, count(*) FILTER (v = 'good')::BIGINT AS good, count(*) FILTER (v = 'fine')::BIGINT AS fine, count(*) FILTER (v = 'bad')::BIGINT AS bad FROM (SELECT doc_id, CASE WHEN toxic = 1 THEN 'bad' WHEN quality = 1 THEN 'good' ELSE 'fine' END AS v FROM labels) GROUP BY 1)",
    "register_shares": "SELECT lang, n, n * 100::DOUBLE / sum(n) OVER () AS share FROM (SELECT lang, count(*)::BIGINT AS n FROM documents GROUP BY 1)",
}
