"""DuckDB wording of the shared steps.  Written apart from the Spark side on purpose."""

from __future__ import annotations

S = r"\t\n\x0B\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
W = r"\p{L}\p{N}_"

KEYWORDS = "'free','winner','offer','credit','urgent','money','bonus','click','remove','unsubscribe'"

# The words of two or more letters, without apostrophes, of Spark's English
# stop list (words with apostrophes are never tokens).
STOP_WORDS = """
me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its
itself they them their theirs themselves what which who whom this that these those am is are was were be been being
have has had having do does did doing an the and but if or because as until while of at by for with about against
between into through during before after above below to from up down in out on off over under again further then once
here there when where why how all any both each few more most other some such no nor not only own same so than too very
can will just don should now cannot could ought would
""".split()
STOP_LIST = ", ".join(f"'{w}'" for w in STOP_WORDS)


def strip_html(e: str) -> str:
    blocks = rf"regexp_replace({e}, '(?is)<script.*?>.*?</script>|<style.*?>.*?</style>', ' ', 'g')"
    return f"regexp_replace({blocks}, '<[^>]+>', ' ', 'g')"


def mask_urls(e: str) -> str:
    return rf"regexp_replace({e}, '(?i)https?://[^{S}]+|www\.[^{S}]+', ' URLTOKEN ', 'g')"


def mask_addresses(e: str) -> str:
    return f"regexp_replace({e}, '[{W}][{W}.+-]*@[{W}-]+[.][{W}.-]*[{W}]', ' EMAILTOKEN ', 'g')"


def squeeze(e: str) -> str:
    return f"trim(regexp_replace({e}, '[{S}]+', ' ', 'g'))"


def strip(e: str) -> str:
    return rf"regexp_replace({e}, '^[{S}]+|[{S}]+\z', '', 'g')"


def normalize(e: str) -> str:
    return rf"regexp_replace({squeeze(e)}, ' +([!?.,;:])', '\1', 'g')"


def clean(e: str) -> str:
    return normalize(mask_addresses(mask_urls(strip_html(f"replace(coalesce({e}, ''), chr(0), ' ')"))))


def name_of(label: str) -> str:
    return f"CASE {label} WHEN 1 THEN 'spam' WHEN 0 THEN 'ham' ELSE '' END"


# Cleaned, labelled documents.
MAIL = f"""
mail AS (
  SELECT doc_id, doc_id::VARCHAR AS email_id, source, label, {name_of('label')} AS label_name, text,
         length(text)::INT AS text_length
  FROM (SELECT d.doc_id, d.source, l.toxic AS label, {clean('d.text')} AS text
        FROM documents d JOIN labels l USING (doc_id) WHERE l.toxic IN (0, 1))
  WHERE length(text) > 0
)"""


def stats(e: str) -> dict[str, str]:
    """Statistics of the text expression `e`; `c` must be its cleaned form."""
    n = f"greatest(length({e}), 1)"
    words = f"regexp_extract_all(c, '[{W}]+')"
    return {
        "char_count": "length(c)::DOUBLE",
        "word_count": f"len({words})::DOUBLE",
        "avg_word_length": f"CASE WHEN len({words}) = 0 THEN 0.0::DOUBLE ELSE list_sum(list_transform({words}, lambda w: length(w)))::DOUBLE / len({words}) END",
        "uppercase_ratio": f"length(regexp_replace({e}, '[^A-Z]', '', 'g'))::DOUBLE / {n}",
        "digit_ratio": rf"length(regexp_replace({e}, '[^\p{{Nd}}]', '', 'g'))::DOUBLE / {n}",
        "exclamation_count": f"(length({e}) - length(replace({e}, '!', '')))::DOUBLE",
        "question_count": f"(length({e}) - length(replace({e}, '?', '')))::DOUBLE",
        "url_count": rf"len(regexp_extract_all({e}, '(?i)https?://[^{S}]+|www\.[^{S}]+'))::DOUBLE",
        "currency_count": f"len(regexp_extract_all({e}, '(?i)[$€£]|usd|eur|vnd'))::DOUBLE",
        "html_tag_count": f"len(regexp_extract_all({e}, '</?[A-Za-z][^>]*>'))::DOUBLE",
        "suspicious_keyword_hits": f"len(list_filter(regexp_extract_all({e}, '[{W}]+'), lambda t: lower(t) IN ({KEYWORDS})))::DOUBLE",
    }


def rule_logit(e: str) -> str:
    s = stats(e)
    return (
        f"(-3.0::DOUBLE + {s['uppercase_ratio']} * 30.0::DOUBLE + {s['digit_ratio']} * 20.0::DOUBLE + {s['exclamation_count']} * 0.05::DOUBLE"
        f" + {s['currency_count']} * 40.0::DOUBLE / greatest(length({e}), 1))"
    )


def rule_probability(e: str, digits: int | None = 6) -> str:
    p = f"1.0::DOUBLE / (1.0::DOUBLE + exp(-{rule_logit(e)}))"
    return p if digits is None else f"round({p}, {digits})"


def _scored(digits: int | None) -> str:
    return f"""{MAIL},
scored AS (
  SELECT *, CASE WHEN p > 0.5 THEN 1 ELSE 0 END AS prediction, greatest(p, 1.0::DOUBLE - p) AS confidence
  FROM (SELECT *, {rule_probability('text', digits)} AS p FROM mail)
)"""


SCORED = _scored(6)
SCORED_UNROUNDED = _scored(None)


def split_ctes(source: str, key: str, seed: int = 42) -> str:
    """CTE `parted`: the rows of `source` with `split`, by plain ranking over a whole label."""

    def shares(out: str, base: str, total: str, draws: str) -> str:
        return f"""
{out}_raw AS (SELECT label, n, {draws} AS draws, n::DOUBLE / {total} * {draws} AS exact FROM {base}),
{out}_rank AS (SELECT *, row_number() OVER (ORDER BY exact - floor(exact) DESC, label) AS place,
                      draws - sum(floor(exact)) OVER () AS spare FROM {out}_raw),
{out} AS (SELECT label, (floor(exact) + CASE WHEN place <= spare THEN 1 ELSE 0 END)::BIGINT AS n FROM {out}_rank)"""

    return f"""
sizes AS (SELECT label, count(*) AS n FROM {source} GROUP BY label),
whole AS (SELECT sum(n)::BIGINT AS n FROM sizes),
rest_total AS (SELECT n - ceil(0.15::DOUBLE * n)::BIGINT AS n FROM whole),
{shares('rest', 'sizes', '(SELECT n FROM whole)', '(SELECT n FROM rest_total)')},
train_total AS (SELECT n - ceil((0.15::DOUBLE / (0.7::DOUBLE + 0.15::DOUBLE)) * n)::BIGINT AS n FROM rest_total),
{shares('train', 'rest', '(SELECT n FROM rest_total)', '(SELECT n FROM train_total)')},
ranked AS (SELECT s.*, row_number() OVER (PARTITION BY label ORDER BY md5('{seed}|' || {key})) AS place FROM {source} s),
parted AS (
  SELECT r.* EXCLUDE (place),
         CASE WHEN place <= z.n - e.n THEN 'test' WHEN place <= z.n - t.n THEN 'validation' ELSE 'train' END AS split
  FROM ranked r JOIN sizes z USING (label) JOIN rest e USING (label) JOIN train t USING (label)
)"""


def word_counts(source: str, text: str, out: str = "tf", key: str = "doc_id") -> str:
    """CTE `out`: (key, term, tf) of words and bigrams."""
    return f"""
{out}_tok AS (SELECT {key}, list_filter(regexp_extract_all({clean(text)}, '[{W}]{{2,}}'), lambda t: t NOT IN ({STOP_LIST})) AS k FROM {source}),
{out} AS (SELECT {key}, term, count(*) AS tf FROM (
    SELECT {key}, unnest(list_concat(k, list_transform(range(1, len(k)), lambda i: k[i] || ' ' || k[i + 1]))) AS term FROM {out}_tok)
  GROUP BY ALL)"""


def char_counts(source: str, text: str, out: str = "tf", key: str = "doc_id") -> str:
    """CTE `out`: (key, term, tf) of padded character 3..5-grams."""
    return f"""
{out}_word AS (SELECT {key}, ' ' || w || ' ' AS w FROM (
    SELECT {key}, unnest(string_split({clean(text)}, ' ')) AS w FROM {source}) WHERE w <> ''),
{out}_gram AS (SELECT {key}, w, unnest([3, 4, 5]) AS n FROM {out}_word),
{out} AS (SELECT {key}, term, count(*) AS tf FROM (
    SELECT {key}, unnest(list_transform(range(1, length(w) - n + 2), lambda i: substring(w, i, n))) AS term
    FROM {out}_gram WHERE n = 3 OR length(w) >= n)
  GROUP BY ALL)"""


def vocabulary(counts: str, source: str, cap: int | None, max_df: float, out: str = "voc") -> str:
    return f"""
{out} AS (SELECT term, df, cf, ln((1.0::DOUBLE + (SELECT count(*) FROM {source})) / (1.0::DOUBLE + df)) + 1.0::DOUBLE AS idf
  FROM (SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM {counts} GROUP BY term)
  WHERE df >= 2 AND df <= {max_df}::DOUBLE * (SELECT count(*) FROM {source})
  {f'ORDER BY cf DESC, term LIMIT {cap}' if cap else ''})"""


def weights(counts: str, voc: str, out: str = "tfidf", key: str = "doc_id") -> str:
    return f"""
{out} AS (SELECT {key}, term, w / sqrt(sum(w * w) OVER (PARTITION BY {key})) AS weight
  FROM (SELECT {key}, term, (1.0::DOUBLE + ln(tf::DOUBLE)) * idf AS w FROM {counts} JOIN {voc} USING (term)))"""
