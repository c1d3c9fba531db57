"""Word lists, patterns and tables that the results depend on.

They are data, stated plainly; the expressions that use them live in ``text`` and ``query``.
"""

# --- character classes (fixed values) ---
WS_SET = r"\t\n\x0B\f\r \xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
WS = f"[{WS_SET}]"
WS_CHARS = (
    "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
CJK_SET = r"\x{3400}-\x{9FFF}"
CJK = f"[{CJK_SET}]"
WORD = "[A-Z0-9_]"
# characters inside search tokens at which the full-text index splits again
SUBTOKEN_SPLIT = r"[_\x{4DC0}-\x{4DFF}]+"

# --- index constants (fixed values) ---
# counts up when stored tokens or postings change
TOKENIZER_VERSION = "3"
CHUNK_CHARS = 700
CHUNK_OVERLAP = 120
CHUNK_MIN = 160
BM25_K1 = 1.2
BM25_B = 0.75
BM25_IDF_FLOOR = 1e-6
RRF_K = 60
VECTOR_WEIGHT = 1.15
LEXICAL_LIMIT = 40
VECTOR_LIMIT = 50
FINAL_LIMIT = 8
TERM_LIMIT = 48
RARE_SHARE = 0.2
LOCATE_TERM_LIMIT = 400
LOCATE_RARE_SHARE = 0.3
LOCATE_LEAST_TERMS = 4
PER_DOCUMENT = 6
SCORE_FLOOR = 0.38
INVENTORY_LIMIT = 4
EPSILON = 2.220446049250313e-16

# --- interrogatives dropped from a query, longest first (fixed values) ---
STOPWORDS = sorted(
    "有哪几种 哪几种 有几种 是哪些 包括哪些 有什么 有哪 哪几 几种 几个 多少种 多少个 多少 几类 哪种 "
    "怎么 如何 怎样 什么 哪些 哪个 为什么 请问 一下 是否 能否 可以 应该 区别 关系 吗 呢 吧 的".split(),
    key=len,
    reverse=True,
)

# --- words that carry no topic (fixed values) ---
META_WORDS = (
    "设置 配置 初始化 使用 说明 介绍 方法 步骤 功能 作用 需要 如果 以及 还有 相关 内容 时候 情况".split()
)

# --- clause separators (fixed value) ---
CLAUSE = rf"[{WS_SET},，、;；:：!！?？。.()（）\[\]【】/]+|的|和|与|及|或|是"

# --- peripheral prefixes in match order (fixed values) ---
PERIPHERALS = (
    "GPIO USART UART SPI I2C ADC DAC TIM RCC NVIC EXTI DMA RTC CAN USB FLASH IWDG WWDG AFIO BKP PWR".split()
)

# --- wording -> added terms (fixed values) ---
ALIASES = [
    ("串口|异步串行", ["UART", "USART"]),
    ("时钟树|时钟|总线", ["RCC", "AHB", "APB"]),
    ("中断控制器|中断", ["NVIC", "EXTI"]),
    ("通用输入输出|输入输出口|引脚", ["GPIO", "AFIO"]),
    ("闪存|存储器|烧写", ["FLASH"]),
    ("模拟数字转换", ["ADC"]),
    ("直接存储器访问", ["DMA"]),
    ("看门狗", ["IWDG", "WWDG"]),
    ("定时器|计数器", ["TIM"]),
]
CORE_TIMER = "SYSTICK|系统节拍"

# --- identifier patterns, without word boundaries (fixed values) ---
CHIP = "STM32[A-Z0-9]{3,}"
IDENTIFIER = (
    r"P[A-G]\d{1,2}"
    r"|(?:GPIO|USART|UART|SPI|I2C|TIM|ADC|DAC|DMA|EXTI|AFIO|NVIC|RCC|FLASH|IWDG|WWDG|BKP|PWR)[A-Z0-9_]*"
    r"|[A-Z]{2,12}_[A-Z0-9_]+"
)
ENTITY = r"STM32[A-Z0-9]+|[A-Z]{1,8}\d{0,3}(?:_[A-Z0-9]+)?|P[A-G]\d{1,2}"

# --- inferred identifiers: all of the words, one of the pattern -> added (fixed values) ---
INFERRED = [
    (["PA9", "USART1_TX"], None,
     ["USART1_REMAP", "AFIO_MAPR", "GPIOA", "GPIOX_CRL", "RCC_APB2ENR", "USART_CR1"]),
    (["USART1_TX"], "配置|设置|重映射", ["USART1_REMAP", "AFIO_MAPR"]),
    (["ADC"], "采样时间|SMPR", ["ADC_SMPR1", "ADC_SMPR2"]),
    (["GPIO"], "MODE|模式|配置", ["GPIOX_CRL", "GPIOX_CRH"]),
    (["NVIC"], None, ["ISER", "ICER", "IPR"]),
]

# --- intents, first match wins (fixed values) ---
INTENTS = [
    ("configure", "怎么|如何|配置|设置|初始化|使能"),
    ("register", "寄存器|位|地址|复位值|CNF|MODE|MAPR"),
    ("parameter", "参数|电压|电流|频率|温度|功耗|速率"),
    ("pin", "引脚|封装|P[A-D][0-9]"),
    ("troubleshoot", "错误|失败|不工作|无输出|排查|原因"),
]
INTENT_LABELS = {
    "configure": "如何配置/操作",
    "register": "寄存器与位域说明",
    "parameter": "参数与指标",
    "pin": "引脚与封装",
    "troubleshoot": "故障排查",
    "general": "一般性说明",
}

# --- concepts: id, triggers, terms (fixed values) ---
CONCEPTS = [
    ("usart", "串口|串行|USART|UART", "USART UART USART_BRR USART_CR1"),
    ("gpio", "引脚|端口|GPIO|输入输出|I/O", "GPIO GPIOx_CRL GPIOx_CRH"),
    ("remap", "重映射|重映像|复用功能|AFIO", "AFIO_MAPR REMAP AFIO"),
    ("timer", "定时器|计数器|TIM", "TIM TIMx_PSC TIMx_ARR TIMx_CR1"),
    ("nvic", "中断优先级|NVIC|中断向量", "NVIC NVIC_IPR ISER ICER"),
    ("exti", "外部中断|EXTI|边沿触发", "EXTI EXTI_RTSR EXTI_FTSR AFIO_EXTICR"),
    ("adc", "模数|模拟数字|ADC|采样", "ADC ADC_SMPR1 ADC_SMPR2 ADC_CR2"),
    ("dma", "DMA|直接存储器访问", "DMA DMA_CCR DMA_CPAR DMA_CMAR"),
    ("iwdg", "独立看门狗|IWDG", "IWDG IWDG_PR IWDG_RLR IWDG_KR"),
    ("wwdg", "窗口看门狗|WWDG", "WWDG WWDG_CR WWDG_CFR"),
    ("pwr", "低功耗|睡眠模式|停止模式|待机模式|电源控制|PWR", "PWR PWR_CR PWR_CSR SLEEPDEEP"),
    ("rcc", "时钟|RCC|PLL", "RCC RCC_CR RCC_CFGR PLL"),
    ("flash", "闪存|FLASH|烧写", "FLASH FLASH_CR FLASH_SR"),
    ("spi", "SPI|主从模式", "SPI SPI_CR1 SPI_SR"),
    ("i2c", "I2C|IIC|从机地址", "I2C I2C_OAR1 I2C_CR1"),
    ("can", "CAN|过滤器|筛选器", "CAN CAN_FMR CAN_FA1R"),
    ("rtc", "实时时钟|RTC", "RTC RTC_CR RTC_ALR"),
    ("bkp", "备份区域|备份寄存器|BKP", "BKP BKP_DR"),
    ("usb", "USB|设备模式|主机模式|OTG", "USB OTG_FS"),
    ("systick", "SYSTICK|系统节拍", "SysTick STK_CTRL STK_LOAD"),
    ("preemption", "抢占优先级|响应优先级|优先级", "NVIC_IPR preemption subpriority"),
    ("prescaler", "预分频|分频系数", "PSC PR prescaler"),
    ("reload", "自动重装载|重装载|ARR", "ARR RLR auto-reload"),
    ("pu-pd", "推挽|开漏|上拉|下拉", "CNF push-pull open-drain"),
    ("idle", "空闲中断|IDLE", "IDLE USART_SR"),
    ("interrupt", "中断", "IRQ interrupt"),
]

# --- aspects: id, query, keywords (fixed values) ---
ASPECTS_REMAP = [
    ("pin", "PA9 USART1_TX 引脚定义 默认复用功能 TIM1_CH2", ["PA9"]),
    ("remap", "USART1_REMAP AFIO_MAPR PA9 PB6 重映射", ["USART1_REMAP"]),
    ("gpio-mode", "GPIOA GPIOx_CRL MODE CNF 复用推挽 输出速度", ["GPIOX_CRL", "GPIO_CRL"]),
    ("clock", "RCC_APB2ENR GPIOA USART1 时钟使能 APB2", ["RCC_APB2ENR"]),
    ("usart-control", "USART_CR1 UE TE USART1 发送使能 配置", ["USART_CR1"]),
]
ASPECTS_ADC = [
    ("adc-sample-time", "ADC_SMPR1 ADC_SMPR2 SMP 采样时间", ["ADC_SMPR1", "ADC_SMPR2", "SMP", "采样时间"]),
    ("adc-control", "ADC_CR2 ADON 转换 校准 规则通道", ["ADC_CR2", "ADON"]),
]
ASPECTS_GPIO = [
    ("gpio-mode", "GPIOx_CRL GPIOx_CRH MODE CNF 输入 输出 复用", ["GPIOX_CRL", "GPIOX_CRH", "MODE", "CNF"]),
]
TIMER_INVENTORY = "timer-inventory"
ASPECTS_TIMER = [
    (
        TIMER_INVENTORY,
        "STM32F103x8B 数据手册 1个高级控制定时器 3个通用16位定时器 2个看门狗定时器 7个定时器 定时器功能比较",
        ["7个定时器", "1个高级控制定时器", "3个通用16位定时器", "定时器功能比较"],
    ),
]
SAMPLING = "采样时间|SMPR"
MODE_WORDS = "MODE|模式|配置"
QUANTITY = "几个|多少|数量|计数|个数"

# --- variant weights (fixed values) ---
WEIGHT_RAW, WEIGHT_BASE, WEIGHT_KEYWORDS = 0.9, 1.05, 1.25
WEIGHT_CONCEPTS, WEIGHT_LONGEST, WEIGHT_ASPECT = 0.95, 1.15, 0.85

# --- re-ranking patterns (fixed values) ---
NAVIGATION = "相关文档|目录|参考文献"
DOT_LEADER = r"\.{4,}"
TITLE_REFERENCE = "参考手册|REFERENCE MANUAL"
TITLE_DATASHEET = "数据手册|DATASHEET"
TITLE_PINS = "引脚定义|PINOUT"
TITLE_FIRMWARE = "固件函数库|FIRMWARE"
FIRMWARE_WORDS = "函数|代码|库|API|初始化|配置"
INVENTORY_WORDS = "定时器|ADC|USART|SPI|I2C|通信接口"
INVENTORY = ["7个定时器", "1个高级控制定时器", "3个通用16位定时器", "3个普通定时器", "定时器功能比较"]

# --- OCR punctuation mapped to a space (fixed value) ---
OCR_PUNCTUATION = r"[，。、；：？！“”‘’（）()《》【】\[\]·|,.;:?!]"

# --- messages and prompt wording (fixed values) ---
MSG_NO_VECTORS = "尚未配置向量模型，本次仅使用关键词与结构检索。"
MSG_VECTORS_FAILED = "向量检索失败，已使用关键词检索："
MSG_NO_HITS = "知识库中没有找到足够相关的资料。"
MSG_NO_TEXT = "没能从这张图里识别出文字。请确认系统已安装中文 OCR 语言包，或换一张更清晰的截图。"
MSG_FEW_TERMS = "识别到的文字太少，无法定位页面。"
MSG_NO_PAGE = "在所选资料里没有找到与截图匹配的页面。"
MSG_LOW_CONFIDENCE = "匹配置信度偏低，建议核对候选页面或把截图拍得更清晰。"
MSG_CLOSE_SCORES = "有多个页面得分接近，已按顺序列出，请确认是否为目标页。"
MSG_UNSUPPORTED = "不支持的文件类型："
MSG_NO_CHAT = "尚未配置聊天 API，因此现在只展示本地检索结果，不生成技术结论。"
DEFAULT_TITLE = "新对话"
FALLBACK_LABEL = "参考资料："
PROMPT_SYSTEM = "\n".join(
    [
        "你是 STM32 手册知识库助手。",
        "只能依据用户消息中提供的证据回答，不得使用未提供的记忆或猜测。",
        "寄存器、位域、地址、复位值、引脚和电气参数必须保持原文数值。",
        "每个关键技术结论后至少标注一个来源，例如 [S1]。",
        "如果证据不足，明确说明无法从当前手册资料确认。",
        "配置类问题按步骤说明；概念对比类先逐项对比再总结；数量/参数类给出确切数值并标注出处。",
        "如果证据里同时出现多份手册，优先引用最直接回答问题的章节。",
        "回答使用中文，先给结论，再给配置步骤或说明。",
        "使用标准 Markdown 排版：标题、编号列表、短段落和行内代码。",
        "寄存器名、位名和代码标识符使用反引号，例如 `USART1_REMAP`。",
        "不要输出 HTML、JSON、转义序列、控制字符或把整篇回答包进代码块。",
    ]
)
PROMPT_QUESTION = "问题："
PROMPT_CONCEPTS = "本题关键概念："
PROMPT_INTENT = "提问意图："
PROMPT_EVIDENCE = "可用证据："
PROMPT_CLOSING = "请给出答案，并使用 [S#] 标注依据。"
