"""SQL fragments that several queries share."""

#: Fully cleaved tryptic peptides of a sequence.
PARTS = "list_filter(string_split(replace(regexp_replace(sequence, '([KR])', '\\1|', 'g'), '|P', 'P'), '|'), lambda x: x <> '')"


def count_sql(letters: dict, seq: str = "sequence") -> str:
    return "(" + " + ".join(f"(length({seq}) - length(replace({seq}, '{k}', ''))) * CAST({v!r} AS DOUBLE)" for k, v in letters.items()) + ")"
