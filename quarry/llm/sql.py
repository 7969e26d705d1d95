"""DuckDB SQL of the queries that SQL can express."""

from quarry.llm import licences

_RATES = ("symbol", "bang", "upper", "dup_line", "repeat")


def _rules(table: str) -> str:
    """Common table expressions, the last of which, judged, has the counts and verdicts of table."""
    bucket = "CASE WHEN x < 32 THEN x ELSE (length(bin(x)) - 4) * 16 + (x >> (length(bin(x)) - 5)::BIGINT) - 16 END"
    least = lambda b: f"CASE WHEN {b} < 32 THEN {b} ELSE ({b} - (({b} // 16) - 1) * 16) << (({b} // 16) - 1) END"
    cut = lambda keys: f"""SELECT {keys} rate, max(total) AS rows_, {least("min(CASE WHEN upto * 10 >= total * 9 THEN b END)")} + 10 * ({least("(min(CASE WHEN upto * 10 >= total * 9 THEN b END) + 1)")} - min(CASE WHEN upto * 2 >= total THEN {least("b")} END)) AS cut
      FROM (SELECT {keys} rate, b, sum(n) OVER (PARTITION BY {keys} rate ORDER BY b) AS upto, sum(n) OVER (PARTITION BY {keys} rate) AS total
            FROM (SELECT {keys} rate, b, sum(n) AS n FROM sketch GROUP BY ALL)) GROUP BY ALL"""  # noqa: E731
    bounded = lambda g, parent: f"CASE WHEN {g}.rows_ >= 200 THEN least({g}.cut, 2 * {parent}) ELSE {parent} END"
    values = ", ".join(f"('{r}', r_{r}, x_{r})" for r in _RATES)
    of = {"symbol": ("n_symbols", "word_chars"), "bang": ("n_bangs", "word_chars"), "upper": ("n_upper", "word_chars"), "dup_line": ("n_dup_lines", "n_lines"), "repeat": ("n_repeat_words", "n_words")}
    rates = lambda p, less: ", ".join(f"CASE WHEN {of[r][1]} = 0 THEN 0 ELSE 10000 * greatest({of[r][0]} - {n}, 0) // {of[r][1]} END AS {p}_{r}" for r, n in less.items())
    return f"""
    base AS (SELECT *, coalesce(text, '') AS t_ FROM {table}),
    split_ AS (SELECT *, regexp_extract_all(t_, '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(t_, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM base),
    wins AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM split_ WHERE len(w) > 2)),
    twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS c FROM wins) WHERE c > 1),
    rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
    counted AS (SELECT s.*, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
        length(regexp_replace(t_, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, length(regexp_replace(t_, '[^!?]+', '', 'g'))::BIGINT AS n_bangs,
        length(regexp_replace(t_, '\\P{{Lu}}+', '', 'g'))::BIGINT AS n_upper, len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
        coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM split_ s LEFT JOIN rep r ON s.doc_id = r.doc_id),
    rated AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
        {rates("r", dict.fromkeys(_RATES, 0))}, {rates("x", {"symbol": 1, "bang": 1, "upper": 1, "dup_line": 1, "repeat": 6})} FROM counted),
    long_ AS (SELECT d.lang, d.source, v.rate, v.x FROM rated d, LATERAL (VALUES {values}) AS v(rate, x, y) WHERE NOT base_failed),
    sketch AS (SELECT lang, source, rate, {bucket} AS b, count(*) AS n FROM long_ GROUP BY ALL),
    fine AS ({cut("lang, source,")}),
    coarse AS ({cut("lang,")}),
    whole AS ({cut("")}),
    langs AS (SELECT c.lang, c.rate, {bounded("c", "a.cut")} AS cut FROM coarse c JOIN whole a ON c.rate = a.rate),
    cuts AS (SELECT f.lang, f.source, f.rate, {bounded("f", "l.cut")} AS cut FROM fine f JOIN langs l ON f.lang IS NOT DISTINCT FROM l.lang AND f.rate = l.rate),
    bad AS (SELECT DISTINCT d.doc_id FROM (SELECT doc_id, lang, source, v.rate, v.y FROM rated, LATERAL (VALUES {values}) AS v(rate, x, y)) d
        JOIN cuts c ON d.lang IS NOT DISTINCT FROM c.lang AND d.source IS NOT DISTINCT FROM c.source AND d.rate = c.rate WHERE d.y > c.cut),
    judged AS (SELECT *, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept FROM rated)"""


OP10 = f"""WITH {_rules("documents").strip()}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged"""

OP7 = """WITH RECURSIVE users AS (SELECT conv_id, turn, text, (3 * conv_id + turn) % 10 AS kind, (conv_id + turn) % 7 AS fault FROM conversations WHERE role = 'user'),
    edges AS (SELECT u.conv_id, u.turn, n.turn AS need FROM users u JOIN users n ON u.conv_id = n.conv_id AND n.turn = CASE WHEN u.kind IN (0, 1, 3, 6, 7, 8, 9) THEN u.turn + 2 WHEN u.kind = 2 THEN u.turn - 2 END),
    reach AS (SELECT conv_id, turn, need FROM edges UNION SELECT r.conv_id, r.turn, e.need FROM reach r JOIN edges e ON r.conv_id = e.conv_id AND r.need = e.turn),
    circles AS (SELECT conv_id, turn FROM reach WHERE turn = need),
    fars AS (SELECT conv_id, turn, max(need) AS far FROM reach GROUP BY conv_id, turn),
    stuck AS (SELECT DISTINCT r.conv_id, r.turn FROM reach r JOIN circles c ON r.conv_id = c.conv_id AND r.need = c.turn
        JOIN fars f ON r.conv_id = f.conv_id AND r.turn = f.turn JOIN fars g ON c.conv_id = g.conv_id AND c.turn = g.turn WHERE f.far = g.far AND f.far >= r.turn),
    places AS (SELECT u.conv_id, u.turn, greatest(u.turn, coalesce(f.far, u.turn)) AS far, s.turn IS NOT NULL AS cyclic
        FROM users u LEFT JOIN fars f ON u.conv_id = f.conv_id AND u.turn = f.turn LEFT JOIN stuck s ON u.conv_id = s.conv_id AND u.turn = s.turn),
    moved AS (SELECT conv_id, turn, far FROM places WHERE NOT cyclic AND far > turn),
    paths AS (SELECT conv_id, turn, turn AS upto, 1 AS step FROM moved UNION
        SELECT p.conv_id, p.turn, e.need, p.step + 1 FROM paths p JOIN edges e ON p.conv_id = e.conv_id AND p.upto = e.turn
            JOIN moved m ON m.conv_id = e.conv_id AND m.turn = e.need JOIN moved o ON o.conv_id = p.conv_id AND o.turn = p.turn AND o.far = m.far),
    steps AS (SELECT conv_id, turn, max(step) AS step FROM paths GROUP BY ALL),
    once AS (SELECT u.*, 'call-' || u.conv_id || '-' || u.turn AS call_id, p.cyclic, CASE WHEN p.cyclic THEN u.turn ELSE p.far END AS place, coalesce(s.step, 0) AS step,
        CASE WHEN fault = 1 THEN 1 WHEN fault IN (2, 3) THEN 1 ELSE 0 END + CASE WHEN fault <> 1 AND text IS NULL THEN 1 ELSE 0 END AS n_errors,
        '{' || concat_ws(',', CASE WHEN fault <> 1 THEN '"text":' || to_json(text) END, CASE WHEN fault = 2 THEN '"turn":"' || u.turn || '"' ELSE '"turn":' || u.turn END, CASE WHEN fault = 3 THEN '"urgent":true' END) || '}' AS arguments
        FROM users u JOIN places p ON u.conv_id = p.conv_id AND u.turn = p.turn LEFT JOIN steps s ON u.conv_id = s.conv_id AND u.turn = s.turn),
    calls AS (SELECT *, false AS again FROM once UNION ALL SELECT *, true FROM once WHERE (conv_id + turn) % 4 = 0),
    results AS (SELECT conv_id, 'call-' || conv_id || '-' || (turn - 1) AS call_id, count(*) AS n_results, min(turn) AS turn, arg_min(text, (turn, text)) AS content
        FROM conversations WHERE role = 'assistant' GROUP BY ALL)
SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, coalesce(c.turn, r.turn) AS turn, coalesce(c.place, r.turn) AS place, coalesce(c.step, 0)::BIGINT AS step, coalesce(c.cyclic, false) AS cyclic,
    CASE WHEN c.call_id IS NULL THEN 'orphan' WHEN c.again THEN 'repeated' WHEN r.call_id IS NULL THEN 'unanswered' ELSE 'linked' END AS status, coalesce(r.n_results, 0) AS n_results,
    c.n_errors::INTEGER AS n_errors,
    '{' || concat_ws(',', '"arguments":' || c.arguments, '"id":' || to_json(coalesce(c.call_id, r.call_id)), CASE WHEN c.call_id IS NOT NULL THEN '"name":"reply"' END, CASE WHEN NOT coalesce(c.again, false) THEN '"result":' || to_json(r.content) END) || '}' AS message
FROM calls c FULL JOIN results r ON c.conv_id = r.conv_id AND c.call_id = r.call_id"""


def _licences(least: float = licences.LEAST) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({quoted(name)}, [{', '.join(map(quoted, grams))}])" for name, grams in licences._table())
    table = [grams for _, grams in licences._table()]
    anchors = ", ".join(f"({quoted(gram)}, {quoted(name)}, {o}, {n}, [{', '.join(map(quoted, table[t]))}])" for t, (name, n, places) in enumerate(licences._windows()) for o, gram in places)
    hinted = " OR ".join(f"contains(lower(text), {quoted(h)})" for h in licences.HINTS)
    return f"""WITH templates(licence, grams) AS (VALUES {rows}),
    whole AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    lines AS (SELECT doc_id, u.i AS line, ls[u.i] AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM whole), LATERAL unnest(range(1, len(ls) + 1)) AS u(i)),
    segments AS (SELECT doc_id, line::INTEGER AS line, text FROM lines UNION ALL SELECT doc_id, 0, text FROM whole WHERE contains(text, chr(10))),
    words AS (SELECT doc_id, line, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+(?:[.]\\p{{N}}+)*') AS w FROM segments),
    grams AS (SELECT doc_id, line, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM words WHERE len(w) > 1),
    hits AS (SELECT doc_id, line, licence, 2.0::DOUBLE * len(list_intersect(b, t.grams)) / (len(b) + len(t.grams)) AS dice FROM grams g JOIN templates t ON len(b) >= {least / (2 - least)} * len(t.grams) - 1e-9 AND len(b) <= {(2 - least) / least} * len(t.grams) + 1e-9),
    texts AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+(?:[.]\\p{{N}}+)*') AS w, list_transform(string_split(text, chr(10)), lambda l: len(regexp_extract_all(lower(l), '[\\p{{L}}\\p{{N}}]+(?:[.]\\p{{N}}+)*'))) AS c
        FROM whole WHERE contains(text, chr(10)) AND ({hinted})),
    anchors(gram, licence, o, n, grams) AS (VALUES {anchors}),
    spots AS (SELECT doc_id, u.i AS i, w[u.i] || ' ' || w[u.i + 1] AS gram FROM texts, LATERAL unnest(range(1, len(w))) AS u(i)),
    starts AS (SELECT DISTINCT s.doc_id, a.licence, a.n, a.grams, greatest(s.i - 1 - a.o, 0) AS at_ FROM spots s JOIN anchors a ON s.gram = a.gram),
    windows AS (SELECT s.*, t.c, list_distinct(list_transform(range(at_ + 1, least(at_ + n, len(t.w))), lambda i: t.w[i] || ' ' || t.w[i + 1])) AS b FROM starts s JOIN texts t ON s.doc_id = t.doc_id),
    found AS (SELECT *, 2.0::DOUBLE * len(list_intersect(b, grams)) / (len(b) + len(grams)) AS dice FROM windows),
    every AS (SELECT doc_id, line, licence, dice FROM hits WHERE dice >= {least} UNION ALL
        SELECT doc_id, (len(list_filter(range(1, len(c) + 1), lambda k: list_sum(c[1:k]) <= at_)) + 1)::INTEGER AS line, licence, dice FROM found WHERE dice >= {least}),
    good AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, licence, line) AS r, count(DISTINCT line) OVER (PARTITION BY doc_id) AS n FROM every)
    SELECT d.doc_id, g.licence, g.dice, g.line, coalesce(g.n, 0)::BIGINT AS n_matches FROM documents d LEFT JOIN (SELECT * FROM good WHERE r = 1) g ON d.doc_id = g.doc_id"""


OP3 = _licences()
