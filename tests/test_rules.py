from pagesift.sources import rules as R


def test_given_keys_replace_whole_keys():
    rules = R.rules_of({"min_word_count": "3", "boilerplate_keywords": ["x"]})
    assert rules.min_word_count == 3
    assert rules.boilerplate_keywords == ("x",)
    assert rules.excluded_section_titles == R.FALLBACK_RULES.excluded_section_titles


def test_overlay_and_back(spark):
    user = R.rules_table(spark, {"boilerplate_phrases": ["b", "a"], "min_word_count": 2})
    table = R.overlay_rules(user, R.rules_table(spark, R.FALLBACK_RULES))
    rules = R.rules_from_table(table)
    assert rules.boilerplate_phrases == ("b", "a")
    assert rules.min_word_count == 2
    assert rules.excluded_categories == R.FALLBACK_RULES.excluded_categories
    assert R.rules_from_table(R.rules_table(spark, R.DEFAULT_RULES)) == R.DEFAULT_RULES


def test_missing_types_have_the_fallback(spark):
    rules = R.rules_from_table(R.rules_table(spark, {"min_word_count": 7}))
    assert rules == R.rules_of({"min_word_count": 7})
    assert rules.boilerplate_keywords == R.FALLBACK_RULES.boilerplate_keywords
