import re

from spanwright.llm import quality_rules as q


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {p for i, w in enumerate(windows) if windows.count(w) > 1 for p in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_measurements_match_brute_force(spark, documents):
    base = "a b c d e f g h i j k"
    texts = [None, "", base, f"{base} {base}", "x " * 40, f"{base}\n\n{base}\n \n z {base} a b", "#a *b <c>\n#a *b <c>", "é ü\x0bñ"]
    rows = {r.doc_id: r for r in q.ledger(documents(*enumerate(texts))).collect()}
    for k, text in enumerate(texts):
        r = rows[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(text), text


def test_policies_and_ablation(spark, documents):
    good = " ".join(f"word{k}" for k in range(30))
    docs = documents((1, good), (2, "too short"), (3, "same " * 50), (4, good.upper() + "".join(f" ##{k}" for k in range(40))))
    ledger = q.ledger(docs)
    kept = {r.doc_id: r.kept for r in q.apply_policy(ledger).collect()}
    assert kept == {1: True, 2: False, 3: False, 4: False}
    assert {r.doc_id for r in q.apply_policy(ledger, "base-1").where("kept").collect()} == {1, 4}
    rules = {r.rule: r for r in q.ablate(ledger).collect()}
    assert (rules["few_words"].rejected, rules["few_words"].rejected_only, rules["few_words"].kept_without) == (1, 1, 2)


def test_filter_keeps_columns_and_odd_rows_do_not_crash(odd):
    wide = odd.withColumn("n_words", odd.doc_id).withColumn("__row", odd.doc_id)
    assert q.quality_filter(wide).columns == wide.columns
    assert q.ledger(odd).count() == odd.count()
    assert q.quality_filter(odd.limit(0)).count() == 0
