"""Word lists and patterns that results depend on."""

# Chinese surnames, characters of given names, words that are no names, places, mail domains and words near names.
SURNAMES = "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗梁宋郑韩唐冯董萧袁邓许傅沈曾彭苏卢蒋蔡贾丁魏薛叶阎潘杜戴夏钟汪田姜石姚谭廖邹熊陆郝孔白崔康毛邱秦江史顾侯邵孟龙万段雷汤尹黎武乔贺赖龚曹"
NAME_CHARS = "伟芳娜秀敏静丽强磊军洋勇艳杰娟涛明超霞平刚桂英华玲燕辉鹏红婷力莉彬萍莹雪健飞慧峰颖浩欣玉梅琴亮丹凤斌涵轩宇晨阳雨云月星晴智贤德义礼信忠孝仁爱和美好佳优卓俊帅漂三四五六七八九十"
COMMON_WORDS = (
    "财物 财务 财务部 费用 主 主题 王者 李子 张力 刘海 陈旧 杨树 赵州 黄色 周围 吴语 于是 于此 于提交 于电子 于纸质 于我们 于报销 "
    "程序 程度 程的顺 程证明 程式 程中 程上 易于 易记录 易懂 易操作 易维护 金额 金融 金钱 金色 金属 范围 范例 范本 范式 任何关 任何人 任何事 "
    "方面的 方式 方法 方向 谢您的 谢谢 谢意 季度 高达 对于 关于 由于 基于 通过 经过 除了 包括 需要 可以 应该 必须 能够 可能 或者 以及 "
    "这个 那个 什么 怎么 为什么 哪里 什么时候"
).split()
PROVINCES = "北京 上海 天津 重庆 河北 山西 辽宁 吉林 黑龙江 江苏 浙江 安徽 福建 江西 山东 河南 湖北 湖南 广东 海南 四川 贵州 云南 陕西 甘肃 青海 台湾 内蒙古 广西 西藏 宁夏 新疆".split()
CITIES = "北京市 上海市 广州市 深圳市 杭州市 南京市 武汉市 成都市 西安市 郑州市 青岛市 大连市 宁波市 厦门市".split()
MAIL_DOMAINS = "qq.com 163.com 126.com gmail.com sina.com sohu.com".split()
NAME_INDICATORS = (
    "先生 女士 同学 老师 经理 总监 主任 称 叫 是 主席 董事 总裁 副总 部长 科长 处长 局长 市长 省长 书记 秘书 助理 专员 顾问 教授 博士 硕士 学士 医生 "
    "护士 工程师 设计师 律师 会计 出纳 司机 保安 清洁工"
).split()

# Patterns of personal data by type, in the order in which they are tried.
PATTERNS = [
    ("PHONE_NUMBER", r"1[3-9]\d{9}"),
    ("PHONE_NUMBER", r"(\+86[-\s]?)?1[3-9]\d{9}"),
    ("PHONE_NUMBER", r"1[3-9]\d{4}[-\s]?\d{4}"),
    ("ID_CARD", r"[1-6]\d{5}(19|20)\d{2}(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])\d{3}[\dXx]"),
    ("ID_CARD", r"[1-6]\d{7}(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])\d{3}"),
    ("BANK_ACCOUNT", r"\b[1-9]\d{15,18}\b"),
    ("BANK_ACCOUNT", r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b"),
    ("EMAIL_ADDRESS", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"),
    ("URL", r"https?://[^\s一-龥]+"),
    ("URL", r"www\.[^\s一-龥]+\.[a-zA-Z]{2,}"),
    ("IP_ADDRESS", r"\b(?:\d{1,3}\.){3}\d{1,3}\b"),
    ("DATE_TIME", r"\d{4}[-/年]\d{1,2}[-/月]\d{1,2}[日号]?"),
    ("DATE_TIME", r"\d{4}-\d{2}-\d{2}"),
    ("DATE_TIME", r"\d{1,2}:\d{2}(:\d{2})?"),
    ("MONEY", r"[￥¥$]\s*\d+(?:,\d{3})*(?:\.\d{2})?"),
    ("MONEY", r"\d+(?:,\d{3})*(?:\.\d{2})?\s*[元块毛角分]"),
    ("MONEY", r"\d+(?:,\d{3})*(?:\.\d{2})?\s*(?:万|千|百)?元"),
    ("LICENSE_PLATE", r"[京津沪渝冀豫云辽黑湘皖鲁新苏浙赣鄂桂甘晋蒙陕吉闽贵粤青藏川宁琼使领][A-Z][A-Z0-9]{5}"),
    ("QQ_NUMBER", r"[1-9]\d{4,10}"),
]
LOCAL_PHONE = r"\b\d{3}-\d{3}-\d{3}\b"

# What the noise uses.
CURRENCIES = "$ € £ ¥ ₹ ₩ ₽ ₫ ฿ ₴ ₦".split()
FALLBACK_CHARS = "的是在了有和人这中我一不他你们为上个来对生能而要之年地到说时大家都把子就三下自去可还如现得里后以会当起与好用没国动成回什那二作部等学过也手行看只天分还"
SPECIAL_TOKENS = ["[CLS]", "[SEP]", "[PAD]", "[UNK]", "[MASK]"]

# English stop words of the public NLTK list, and the short list of the restoring step.
STOP_WORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his himself she she's her hers herself it it's its itself "
    "they them their theirs themselves what which who whom this that that'll these those am is are was were be been being have has had having do does did doing a an the "
    "and but if or because as until while of at by for with about against between into through during before after above below to from up down in out on off over under "
    "again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don "
    "don't should should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't "
    "mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't"
).split()
SHORT_STOP = "the and are for not was this that with from have one two but all in on at to of is it be as or by".split()
