import re
import unicodedata

from pyspark.sql import functions as F

from leafmark.functions import query as Q
from leafmark.functions import rules as R
from leafmark.functions import text as X


def values(spark, rows, *columns):
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    return [tuple(r) if len(columns) > 1 else r[0] for r in df.select(*columns).collect()]


T = F.col("t")


def test_nfkc_matches_unicodedata(spark):
    rows = ["ＡＢ①ﬁ straße Å", "plain", "（一），。", "ﾊﾝｶｸ é"]
    assert values(spark, rows, X.nfkc(T)) == [unicodedata.normalize("NFKC", r) for r in rows]


def plain_terms(text):
    folded = unicodedata.normalize("NFKC", text).upper()
    out = [w for w in re.findall("[A-Z0-9_]+", folded) if len(w) > 1 or w.isdigit()]
    for run in re.findall("[㐀-鿿]+", folded):
        out += [run] if len(run) == 1 else [run[i : i + 2] for i in range(len(run) - 1)]
    return list(dict.fromkeys(out))


def test_search_terms(spark):
    rows = ["低功耗模式 PWR_CR a 7 位 PWR_CR", "电", "", "x y", "ＵＳＡＲＴ１ 中断中断"]
    assert values(spark, rows, X.search_terms(T)) == [plain_terms(r) for r in rows]


def test_query_keywords(spark):
    golden = {
        "低功耗模式有哪几种": ["低功耗模式"],
        "GPIO 推挽输出和开漏输出有什么区别": ["GPIO", "推挽输出", "开漏输出"],
        "PA9 怎么配置成 USART1_TX": ["PA9", "USART1_TX"],
        "CAN 总线过滤器怎么设置": ["CAN", "总线过滤器"],
        "独立看门狗的溢出时间怎么算": ["独立看门狗", "溢出时间"],
    }
    found = values(spark, list(golden), X.query_keywords(T))
    for have, want in zip(found, golden.values()):
        assert [w for w in want if w in have] == want


def plain_chunks(text, most=700, overlap=120, least=160):
    out, start = [], 0
    while start < len(text):
        end = min(start + most, len(text))
        if end < len(text):
            for i in range(end, min(len(text), start + least) - 1, -1):
                after = text[i + 1] if i + 1 < len(text) else ""
                if text[i] in "\n。！？；.!?;" or (text[i] == " " and "㐀" <= after <= "鿿"):
                    end = i + 1
                    break
        piece = text[start:end].strip()
        if piece:
            out.append(piece)
        if end >= len(text):
            break
        start = max(start + 1, end - overlap)
        while start < len(text) and text[start].isspace():
            start += 1
    return out


def test_chunks_follow_the_rules(spark):
    rows = [
        "A" * 1000,
        "A" * 701,
        "A" * 700 + ".",
        "B" * 650 + " 低功耗模式" + "C" * 900,
        "word. " * 400,
        "行\n" * 900,
        "x" * 159 + "." + "y" * 900,
        "a " * 50 + "。" + "z" * 1500 + "! end",
    ]
    found = values(spark, rows, X.chunk_texts(T))
    assert found == [plain_chunks(r) for r in rows]
    assert len(found[0]) == 2 and len(found[0][0]) == 700 and len(found[0][1]) == 420


def test_small_chunk_parameters(spark):
    text = "one two. three four; five six! " * 9
    (found,) = values(spark, [text.strip()], X.chunk_texts(T, 60, 10, 20))
    assert found == plain_chunks(text.strip(), 60, 10, 20)


def test_normalisers(spark):
    assert values(spark, ["结论：​PA9\r\n\r\n\r\n\r\n**配置**  \n"], X.normalize_answer(T)) == ["结论：PA9\n\n**配置**"]
    rows = ["低 功 耗 模 式", "usart1 brr", "低功耗模式（一）"]
    assert values(spark, rows, X.ocr_text(T)) == ["低功耗模式", "USART1 BRR", "低功耗模式 一"]
    assert values(spark, ["a \t\n\n\n\nb\x00  c　"], X.normalize_page_text(T)) == ["a\n\nb c"]
    assert values(spark, ["k1 and k1"], X.redact(T, F.lit("k1"), F.lit(""), F.lit(None).cast("string"))) == ["[REDACTED] and [REDACTED]"]
    assert values(spark, ["x" * 500], F.length(X.excerpt(T))) == [420]
    assert values(spark, ["  \n "], X.conversation_title(T)) == [R.DEFAULT_TITLE]


def test_printed_page(spark):
    rows = ["页 12 / 40 x 3/9", "see 7/8", "第 5 页", "none"]
    assert values(spark, rows, X.printed_page(T, F.lit(99))) == ["12", "7", "5", "99"]


def test_names_models_and_endpoints(spark):
    assert values(spark, ["a.b.pdf", "noext", ".hidden"], X.title_from_filename(T)) == ["a.b", "noext", ".hidden"]
    message = "The supported API model names are deepseek-flash, deepseek-v4-pro, but you passed x."
    assert values(spark, [message, "other"], X.supported_models(T)) == [["deepseek-flash", "deepseek-v4-pro"], []]
    models = X.strings(["text-embedding-3", "chat-a"])
    assert values(spark, ["x"], X.preferred_model(models, "chat"), X.preferred_model(models, "embedding")) == [("chat-a", "text-embedding-3")]
    assert values(spark, [" http://h/v1// ", "http://h/embeddings"], X.endpoint(T, "embeddings")) == ["http://h/v1/embeddings", "http://h/embeddings"]
    assert values(spark, ["[S1] [S12] [x]"], X.link_citations(T)) == ["[S1](#citation-S1) [S12](#citation-S12) [x]"]


def test_query_analysis(spark):
    asked = spark.createDataFrame(
        [(1, "STM32F103C8T6 的 PA9 怎么配置成 USART1_TX"), (2, "今天天气怎么样"), (3, "SysTick 定时器"), (4, "通用定时器有几个")],
        "query_id long, question string",
    )
    rows = {r.query_id: r for r in Q.analyze(asked).collect()}
    first = rows[1]
    assert "STM32F103C8T6" in first.chip_models and first.intent == "configure"
    assert {"PA9", "USART1_TX", "USART1_REMAP"} <= set(first.identifiers)
    assert "USART" in first.peripherals
    assert [a.id for a in first.aspects] == ["pin", "remap", "gpio-mode", "clock", "usart-control"]
    assert len(first.variants) >= 5
    assert rows[2].concepts == [] and rows[2].aspects == []
    assert "TIM" not in rows[3].aliases
    assert [a.id for a in rows[4].aspects] == ["timer-inventory"]


def test_concepts(spark):
    found = values(spark, ["独立看门狗溢出时间怎么算"], Q.expand_concepts("t"), Q.detect_concepts("t"))
    assert {"IWDG", "IWDG_PR", "IWDG_RLR"} <= set(found[0][0]) and "iwdg" in found[0][1]
