from codeloom.operators import statistics as S

SUMMARY = "Program string, InitialCompilePass string, FinalCompilePass string, RuntimePass string, FunctionalPass string, RepairRounds string, TotalTime double, TranslationTime double, ValidationTime double, GeneratedTestCount int, ExecutedTestCount int, PassedTestCount int, SuccessRate double, PromptTokens long, CompletionTokens long, TotalTokens long"
DETAIL = "Program string, ErrorType string, ErrorCategory string, FailureReason string, TranslationTime double, CompileTime double, RuntimeTime double, ValidationTime double, RepairTime double, GeneratedTestCount int, PassedTestCount int"


def summary(spark):
    return spark.createDataFrame(
        [
            ("program_1", "False", "True", "yes", "pass", "2", 10.0, 1.0, 0.0, 5, 5, 4, 0.8, 10, 20, 30),
            ("program_1", "True", "True", "True", "True", "0", 4.0, float("nan"), 2.0, 0, 0, 0, 0.0, None, None, None),
            ("program_2", None, "", "False", "True", "3.0", None, -1.0, 4.0, 7, 7, 7, 1.0, 0, 0, 9),
            ("example", "True", "True", "True", "True", "9", 99.0, 9.0, 9.0, 9, 9, 9, 1.0, 1, 1, 2),
        ],
        SUMMARY,
    )


def detail(spark):
    return spark.createDataFrame([("program_1", "None", "None", "", 1.0, 2.0, 0.0, None, 0.0, 5, 1), ("program_1", "SyntaxError", "x", "r", 3.0, 4.0, 1.0, None, 2.0, None, 1), ("only_detail", "", None, None, float("nan"), 1.0, 1.0, 1.0, 1.0, 1, 1)], DETAIL)


def test_engine_a(spark):
    r = S.rates_a(summary(spark)).first()
    assert (r.total_programs, r.compile_pass, r.runtime_pass, r.functional_pass, r.overall_success) == (3, 2, 2, 3, 2)
    t = S.timing_a(summary(spark), detail(spark)).first()
    assert (t.avg_translation_time, t.avg_validation_time, t.avg_total_time, t.total_experiment_time, t.avg_compile_time) == (1.0, 3.0, 7.0, 10.0, 3.0)
    p = S.repair_a(summary(spark)).first()
    assert (p.programs_repaired, p.avg_repair_rounds, p.max_repair_rounds, p.repair_success_gain) == (2, 2.5, 3, 2)
    k = S.tokens_a(summary(spark)).first()
    assert (k.total_prompt_tokens, k.total_tokens, k.avg_tokens) == (11, 32, 16.0)
    assert {(r.kind, r.label): r.n for r in S.errors_a(detail(spark)).collect()} == {("type", "SyntaxError"): 1, ("category", "x"): 1}


def test_engine_a_falls_back_to_all_rows(spark):
    assert S.rates_a(summary(spark).where("Program = 'example'")).first().total_programs == 1
    assert S.rates_a(summary(spark).limit(0)).first().compile_success_rate == 0


def test_engine_b(spark):
    programs = S.programs_b(summary(spark), detail(spark))
    by = {r.Program: r for r in programs.collect()}
    assert set(by) == {"program_1", "program_2", "example", "only_detail"}
    one = by["program_1"]
    assert one.total_time == 10.0 and one.repair_rounds == 2 and not one.functional and one.rounds == 2 and one.errors == 1
    assert by["program_2"].repair_rounds == 0 and not by["only_detail"].final_compile
    a = S.aggregate_b(programs).first()
    assert a.total_programs == 4 and a.avg_generated_test_count == 2.0 and a.avg_repair_count == (2 + 9 + 0) / 3
    assert a.avg_translation_time == 2.0
    assert S.aggregate_b(S.programs_b(summary(spark).limit(0), detail(spark).limit(0))).first().total_programs == 0


def test_reports(spark):
    assert [(r.ErrorType, r.n, r.share, r.bar) for r in S.top_errors(detail(spark)).collect()] == [("SyntaxError", 1, 100.0, "█" * 20)]
    assert {r.stage: r.level for r in S.findings(summary(spark)).collect()} == {"compile": "some", "runtime": "some", "functional": "high"}
