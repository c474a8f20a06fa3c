"""DuckDB SQL for the corpus queries that SQL can express, written from their definitions, not from the operators."""

from __future__ import annotations

from laurel.llm import mixing, quality, suffix_trees
from laurel.llm.common import WORD

_WORDS = f"regexp_extract_all(coalesce(text, ''), '{WORD}')"


def _seeded(*values: str) -> str:
    parts = ", ".join(f"coalesce(CAST({v} AS VARCHAR), 'null')" for v in values)
    return f"CAST('0x' || substring(md5(concat_ws('|', '{mixing.SEED}', {parts})), 1, 15) AS BIGINT)"


def _mixing() -> str:
    block, most = mixing.BLOCK, mixing.MOST_PASSES
    weight = "CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {} {} END".format(
        len(mixing.WEIGHTS), " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(mixing.WEIGHTS))
    )

    def seats(name: str, parties: str, votes: str, words: str, group: str, tie: str, house: str) -> str:
        """Seat by seat: all quotients of a group in one list, the first ``house`` of them win."""
        return f"""
    {name}_quotients AS (
      SELECT {parties}.*, unnest(range(({most} * {words}) // {block})) AS k FROM {parties}),
    {name}_ranked AS (
      SELECT *, row_number() OVER ({group} ORDER BY {votes} / (2 * k + 1) DESC, {tie}, k) AS rank FROM {name}_quotients),
    {name} AS (SELECT no, shard, count(*) AS seats FROM {name}_ranked WHERE rank <= {house} GROUP BY no, shard)"""

    return f"""
    WITH sized AS (SELECT doc_id, source, len({_WORDS}) AS size FROM documents),
    per_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
    weighed AS (
      SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS no, CAST(0 AS BIGINT) AS shard,
             CAST({weight} AS DOUBLE) AS weight, {most} * source_size AS most,
             CAST(sum(source_size) OVER () AS BIGINT) AS total FROM per_source),
    -- the level of the water if this source is the first, by most / weight, that does not stop
    tried AS (
      SELECT *, row_number() OVER fill AS place,
             (total * {mixing.SHARE_PERCENT} / 100 - CAST(sum(most) OVER fill - most AS BIGINT))
             / (sum(weight) OVER () - (sum(weight) OVER fill - weight)) AS level
      FROM weighed WINDOW fill AS (ORDER BY most / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
    level AS (SELECT arg_min(level, place) AS level FROM tried WHERE weight * level <= most),
    targets AS (
      SELECT no, shard, source, source_size,
             CASE WHEN total = 0 THEN 0.0 ELSE least(weight * (SELECT level FROM level), CAST(most AS DOUBLE)) END AS target
      FROM weighed),
    {seats("source_seats", "targets", "target", "source_size", "", _seeded("source"),
           f"(SELECT floor(sum(target) / {block} + 0.5) FROM targets)")},
    dealt AS (
      SELECT sized.doc_id, sized.size, targets.no, targets.source, {_seeded("sized.doc_id")} AS place,
             place % ((source_size + {mixing.SHARD_WORDS - 1}) // {mixing.SHARD_WORDS}) AS shard
      FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source WHERE size > 0),
    shards AS (
      SELECT dealt.no, dealt.shard, any_value(dealt.source) AS source, CAST(sum(size) AS BIGINT) AS words,
             coalesce(any_value(s.seats), 0) AS house
      FROM dealt LEFT JOIN source_seats AS s ON dealt.no = s.no GROUP BY dealt.no, dealt.shard),
    {seats("shard_seats", "shards", "CAST(words AS DOUBLE)", "words", "PARTITION BY no",
           _seeded("source", "shard") + ", shard", "house")},
    quotas AS (
      SELECT no, shard, words, coalesce(seats, 0) * {block} AS quota, {_seeded("source", "shard")} % words AS phase
      FROM shards LEFT JOIN shard_seats USING (no, shard)),
    -- every word of a run has a number of its own; those that the quota's passes over the circle reach are taken
    run AS (
      SELECT no, shard, doc_id, size, row_number() OVER w AS nth, CAST(sum(size) OVER w AS BIGINT) - size AS start
      FROM dealt WINDOW w AS (PARTITION BY no, shard ORDER BY place, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING)),
    word_rows AS (SELECT *, start + unnest(range(size)) AS spot FROM run),
    taken AS (
      SELECT no, shard, nth, any_value(doc_id) AS doc_id, any_value(size) AS size,
             CAST(sum((quota - (spot - phase + words) % words + words - 1) // words) AS BIGINT) AS taken
      FROM word_rows JOIN quotas USING (no, shard) GROUP BY no, shard, nth)
    SELECT doc_id, size, source_size, target, taken FROM taken JOIN targets ON taken.no = targets.no
    UNION ALL
    SELECT doc_id, size, source_size, target, 0 FROM sized
    JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source WHERE size = 0
    """


def _repeats() -> str:
    window = suffix_trees.WINDOW
    return f"""
    WITH docs AS (SELECT row_number() OVER () AS no, doc_id, {_WORDS} AS words FROM documents),
    placed AS (SELECT no, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM docs),
    starts AS (
      SELECT *, CASE WHEN count(*) OVER span = {window} THEN md5(string_agg(word, ' ') OVER span) END AS sequence
      FROM placed
      WINDOW span AS (PARTITION BY no ORDER BY place ROWS BETWEEN CURRENT ROW AND {window - 1} FOLLOWING)),
    repeated AS (SELECT sequence FROM starts WHERE sequence IS NOT NULL GROUP BY sequence HAVING count(*) > 1),
    covered AS (
      SELECT no, place, word, coalesce(place - max(CASE WHEN repeated.sequence IS NOT NULL THEN place END)
             OVER (PARTITION BY no ORDER BY place) < {window}, false) AS gone
      FROM starts LEFT JOIN repeated USING (sequence)),
    per_doc AS (
      SELECT no, CAST(count(*) FILTER (gone) AS BIGINT) AS n_removed,
             string_agg(word, ' ' ORDER BY place) FILTER (NOT gone) AS kept FROM covered GROUP BY no)
    SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
           sha256(coalesce(kept, '')) AS kept_sha256
    FROM docs LEFT JOIN per_doc USING (no)
    """


def _chat() -> str:
    escaped = r"length(regexp_replace({}, '(\\|###|</turn>)', '\\\1', 'g'))"
    marks = len("### ") + len(": ") + len("</turn>\n")
    control = r"\### Assistant: </turn> ok"
    order = "ORDER BY turn NULLS FIRST, role, text"
    return f"""
    WITH turns AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (
        SELECT conv_id, turn, role, text FROM conversations
        UNION ALL VALUES (-7, 0, 'user', '{control}'), (-7, 1, 'assistant', '{control}'))),
    joined AS (
      SELECT conv_id, count(*) AS n_turns,
             string_agg(role || chr(10) || text || chr(10), '' {order}) AS said,
             coalesce(string_agg(text, '' {order}) FILTER (role = 'assistant'), '') AS learned,
             CAST(sum({marks} + {escaped.format("role")} + {escaped.format("text")}) AS BIGINT) AS formatted_chars
      FROM turns GROUP BY conv_id)
    SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(learned) AS loss_chars,
           sha256(learned) AS loss_sha256, formatted_chars
    FROM joined
    """


def _quality() -> str:
    ratios = {
        "symbols": "1000 * n_symbols / greatest(word_chars, 1)",
        "dup_lines": "1000 * n_dup_lines / greatest(n_lines, 1)",
        "repeats": "1000 * n_repeat_words / greatest(n_words, 1)",
        "word_length": "100 * word_chars / greatest(n_words, 1)",
    }
    measures = ", ".join(f"CAST(floor({ratio}) AS BIGINT) AS {name}" for name, ratio in ratios.items())
    upper = "CASE measure {} END".format(" ".join(f"WHEN '{m}' THEN {q}" for m, (q, _) in quality.TAILS.items()))
    reach = "CASE measure {} END".format(" ".join(f"WHEN '{m}' THEN {r}" for m, (_, r) in quality.TAILS.items()))
    failed = f"(n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEATED_PERCENT} * n_words)"

    def limits(name: str, *keys: str) -> str:
        """Limits per group and measure: quantiles of the values rounded down to their buckets."""
        by = ", ".join((*keys, "measure"))
        return f"""
    {name}_placed AS (
      SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY bucket) AS rank, count(*) OVER (PARTITION BY {by}) AS n
      FROM bucketed),
    {name} AS (
      SELECT {by}, max(n) AS n, min(bucket) FILTER (2 * rank >= n) AS middle,
             min(bucket) FILTER (100 * rank >= {upper} * n) AS high, min(bucket) FILTER (100 * rank >= (100 - {upper}) * n) AS low,
             high + {reach} * greatest(high - middle, 1) AS most,
             CASE measure WHEN 'word_length' THEN low - {reach} * greatest(middle - low, 1) END AS fewest
      FROM {name}_placed GROUP BY {by})"""

    def pick(column: str) -> str:
        """The group's limit drawn to its language's, which is drawn to the one of all documents."""
        parent = f"floor((l.n * l.{column} + {quality.PARENT_DOCS} * o.{column}) / (l.n + {quality.PARENT_DOCS}))"
        return f"floor((g.n * g.{column} + {quality.PARENT_DOCS} * {parent}) / (g.n + {quality.PARENT_DOCS}))"

    return f"""
    WITH docs AS (
      SELECT row_number() OVER () AS no, doc_id, lang, source, {_WORDS} AS words, coalesce(text, '') AS whole,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines
      FROM documents),
    placed AS (SELECT no, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM docs),
    triples AS (
      SELECT no, place, word || ' ' || lead(word) OVER run || ' ' || lead(word, 2) OVER run AS triple
      FROM placed WINDOW run AS (PARTITION BY no ORDER BY place)),
    repeated AS (
      SELECT no, triple FROM triples WHERE triple IS NOT NULL GROUP BY no, triple HAVING count(*) > 1),
    covered AS (
      SELECT DISTINCT no, place + step AS place FROM triples JOIN repeated USING (no, triple), range(3) AS steps(step)),
    repeats AS (SELECT no, count(*) AS n FROM covered GROUP BY no),
    counted AS (
      SELECT no, doc_id, lang, source, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
             length(regexp_replace(whole, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
             len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
             coalesce(repeats.n, 0) AS n_repeat_words
      FROM docs LEFT JOIN repeats USING (no)),
    measured AS (SELECT *, {failed} AS base_failed, {measures} FROM counted),
    cells AS (
      UNPIVOT (SELECT no, lang, source, {", ".join(ratios)} FROM measured WHERE NOT base_failed)
      ON {", ".join(ratios)} INTO NAME measure VALUE value),
    shifted AS (SELECT *, CAST(greatest(length(bin(value)) - 9, 0) AS INTEGER) AS shift FROM cells),
    bucketed AS (SELECT *, (value >> shift) << shift AS bucket FROM shifted),
    {limits("own", "lang", "source")},
    {limits("by_lang", "lang")},
    {limits("overall")},
    judged AS (
      SELECT c.no, bool_and(c.value <= {pick("most")} AND c.value >= coalesce({pick("fewest")}, c.value)) AS within
      FROM cells AS c
      JOIN own AS g ON c.measure = g.measure AND c.lang IS NOT DISTINCT FROM g.lang AND c.source IS NOT DISTINCT FROM g.source
      JOIN by_lang AS l ON c.measure = l.measure AND c.lang IS NOT DISTINCT FROM l.lang
      JOIN overall AS o ON c.measure = o.measure
      GROUP BY c.no)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           coalesce(within, false) AS kept
    FROM measured LEFT JOIN judged USING (no)
    """


def _warc() -> str:
    five_bits = "CAST('0x' || substring(hex, (i // 4 * 5 + 1)::BIGINT, 5) AS BIGINT) >> (15 - 5 * (i % 4))::INTEGER"
    return f"""
    WITH keyed AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
    kept AS (SELECT html, min(page_id) AS kept_id FROM keyed GROUP BY html),
    roles AS (
      SELECT page_id, html, hex, CASE WHEN page_id IS DISTINCT FROM kept_id THEN kept_id END AS refers_to
      FROM keyed JOIN kept USING (html))
    SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
           array_to_string(list_transform(range(32), lambda i:
             substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (({five_bits}) & 31) + 1, 1)), '') AS payload_digest,
           CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to
    FROM roles
    """


def _audit() -> str:
    letters = {
        "A": "n < 100", "B": "100 * distinct_words < 80 * n", "C": "100 * capitals > 10 * chars",
        "D": "regexp_matches(body, '[#$%&*|]')", "E": "doc_id > first_id",
    }
    flags = ", ".join(f"coalesce({test}, false) AS {name}" for name, test in letters.items())
    picked = " || ".join(f"CASE WHEN {name} THEN '{name}' ELSE '' END" for name in letters)
    orders = " JOIN ".join(f"(VALUES {', '.join(f"('{x}')" for x in letters)}) AS t{i}(c{i})" + (
        " ON " + " AND ".join(f"c{i} <> c{j}" for j in range(i)) if i else "") for i in range(5))
    return f"""
    WITH docs AS (
      SELECT row_number() OVER () AS no, doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body, {_WORDS} AS words
      FROM documents),
    measured AS (
      SELECT *, len(words) AS n, len(list_distinct(words)) AS distinct_words, length(body) AS chars,
             length(regexp_replace(body, '[^A-Z]', '', 'g')) AS capitals, min(doc_id) OVER (PARTITION BY body) AS first_id
      FROM docs),
    flagged AS (SELECT no, doc_id, part, {flags} FROM measured),
    marks AS (
      SELECT doc_id, bool_or(quality IS NOT DISTINCT FROM 1) AS good, bool_or(toxic IS NOT DISTINCT FROM 1) AS toxic
      FROM labels GROUP BY doc_id),
    judged AS (
      SELECT part, {picked} AS failed, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
      FROM flagged LEFT JOIN marks USING (doc_id) GROUP BY ALL),
    orders AS (SELECT c0 || c1 || c2 || c3 || c4 AS filter_order FROM {orders}),
    steps AS (
      SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS letter, filter_order[:step - 1] AS earlier
      FROM orders, range(1, 6) AS s(step)),
    cells AS (
      SELECT part, filter_order, step, letter, n, good, toxic, failed = letter AS alone,
             length(translate(failed, earlier, '')) < length(failed) AS gone, contains(failed, letter) AS fails
      FROM judged, steps),
    counted AS (
      SELECT part, filter_order, step, letter, coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0) AS kept,
             coalesce(sum(n) FILTER (fails AND NOT gone), 0) AS removed,
             coalesce(sum(n) FILTER (fails AND gone), 0) AS redundant,
             coalesce(sum(n) FILTER (alone), 0) AS unique_fails,
             coalesce(sum(good) FILTER (fails AND NOT gone), 0) AS good_lost,
             coalesce(sum(toxic) FILTER (fails AND NOT gone), 0) AS toxic_lost
      FROM cells GROUP BY ALL)
    SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
           CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
           CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
           CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
    FROM counted
    """


def _fill_middle() -> str:
    space = r"\x20\x09-\x0D"
    tokens = rf"[{space}]*[^{space}]+|[{space}]+"
    draws = ", ".join(f"CAST('0x' || substring(key, {8 * i + 1}, 8) AS BIGINT) AS h{i + 1}" for i in range(4))
    return rf"""
    WITH docs AS (
      SELECT doc_id, coalesce(text, '') AS body, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key
      FROM documents),
    drawn AS (SELECT *, regexp_extract_all(body, '{tokens}') AS tokens, {draws} FROM docs),
    placed AS (
      SELECT *, len(tokens) AS n, least(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) AS a,
             greatest(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) AS b FROM drawn),
    parts AS (
      SELECT doc_id, body, n, coalesce(array_to_string(tokens[:a], ''), '') AS prefix,
             coalesce(array_to_string(tokens[a + 1:b], ''), '') AS middle,
             coalesce(array_to_string(tokens[b + 1:], ''), '') AS suffix,
             CASE WHEN body = '' OR h3 % 100 >= 50 OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>')
                  THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM placed)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
           CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
           sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                  WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE body END) AS output_sha256,
           sha256(body) AS restored_sha256
    FROM parts
    """


ORACLES: dict[str, str] = {
    "op4_mixing": _mixing(),
    "op5_substring_dedup": _repeats(),
    "op7_chat_format": _chat(),
    "op8_quality": _quality(),
    "op9_warc": _warc(),
    "op11_filter_audit": _audit(),
    "op12_fill_middle": _fill_middle(),
}
