"""Fixed values of the language packs: what stands here must be as it is for results to agree, and nothing here is logic."""

from __future__ import annotations

KINDS = ("number", "quantity", "percentage", "money", "date", "time", "duration", "reference", "identifier", "proper_noun")
#: The longest run that any open-ended repeat of a rule reads.
MAX_RUN = 256

# --- fixed values: punctuation ------------------------------------------------------------------------------------------
BRACKETS = "「」 『』 （） () 【】 《》 〈〉 []"
CLOSING_QUOTES = "\" ' ’ ”"
BULLETS = "- * + ‐ —"
DOT_BULLET = "・"
ORDINAL_MARKS = ". ) 、 ．"
FENCES = "``` ~~~"
ENGLISH_STOPS = ". ! ?"
JAPANESE_STOPS = "。 ！ ？ ．"
CHINESE_STOPS = "。 ！ ？"
SIGNS = "- − ± +"
PERCENT = "% ％"
CURRENCY_SIGNS = "$ € £ ¥ ￥"
FOOT_MARKS, INCH_MARKS = "' ′", '" ″'

# --- fixed values: units ------------------------------------------------------------------------------------------------
UNITS = """
    nm µm mm cm m km in ft mi px pt
    µg ug mg g kg t kt lb lbs oz
    mL ml cc L l
    ns µs ms s min h hr hrs
    mA mAh A V kV W kW kWh hp
    J kJ cal kcal N kN Nm kn
    Pa kPa MPa psi bar
    Hz kHz MHz GHz rpm
    bit B KB kB MB GB TB
    K °C °F ℃ ℉ dB ppm
"""
CURRENCY_CODES = "USD EUR GBP JPY CNY KRW"

# --- fixed values: English ----------------------------------------------------------------------------------------------
TITLES = "Mr Mrs Ms Mx Dr Prof Sir Dame Rev Hon Judge Justice Gov Sen"
LEGAL_FORMS = "Inc Ltd LLC LLP PLC Corp Co Pty GmbH AG KK SA NV BV AB Oy"
CITED = "Annex Appendix Exhibit Schedule"
CITED_ONE_OR_MORE = "Section Article Chapter Clause Paragraph Item Rule Claim Figure Table"
CITED_SHORT = "Sec Art Ch Para No Fig"
MONTHS = "January February March April May June July August September October November December"
SHORT_MONTHS = "Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec"
ORDINAL_ENDINGS = "st nd rd th"
SPANS_OF_TIME = "second minute hour day week month year"
WORKING_DAY = "business day"
SCALE = "thousand million billion trillion"
CURRENCIES = "dollars euros pounds yen"
POWERS = "sq square cu cubic"
LENGTHS_OF_POWERS = "mm cm m km in inch inches ft foot feet yd yds yard yards mi mile miles"
ABBREVIATIONS = """
    mr. mrs. ms. dr. prof. hon. rev. jr. sr. st.
    inc. ltd. llc. plc. co. corp. assn. dept. div.
    jan. feb. mar. apr. jun. jul. aug. sep. sept. oct. nov. dec.
    mon. tue. wed. thu. fri. sat. sun.
    art. arts. sec. secs. ch. chap. para. paras. fig. figs. eq. eqs. tbl. no. nos. p. pp. vol. vols. col. cols. pt. app. ref. refs.
    ed. eds. al. ca. cf. e.g. i.e. etc. est. ibid. op. viz. vs. approx. avg. max. min. wt.
    b.i.d. t.i.d. q.d. p.r.n. p.o. u.s.p.
"""

# --- fixed values: Han numerals -----------------------------------------------------------------------------------------
#: Characters that go on with a number written in Han numerals.
NUMERALS = "〇零一二两三四五六七八九十百千万億亿兆"
JAPANESE_DIGITS, JAPANESE_MAGNITUDES = "〇一二三四五六七八九", "十百千万億兆"
CHINESE_DIGITS, CHINESE_MAGNITUDES = "〇零一二两三四五六七八九", "十百千万亿"
#: Letters for the parties to a contract.
PARTIES = "甲乙丙丁戊"

# --- fixed values: Japanese ---------------------------------------------------------------------------------------------
ERAS = "明治 大正 昭和 平成 令和"
JAPANESE_CITED = "条項号章節編款表図版巻回"
JAPANESE_UNITS = """
    ミリ センチ キロ ミリメートル センチメートル メートル キロメートル
    ミリグラム グラム キログラム トン ミリリットル リットル
    平方センチメートル 平方メートル 平方キロメートル 立方センチメートル 立方メートル
    パーセント ポイント
"""
JAPANESE_COUNTERS = """
    秒 分 分間 時 時間 日 日間 週 週間 月 か月 ヶ月 カ月 年 年間 年度
    人 名 才 歳 件 個 箇月 本 枚 冊 台 軒 棟 口 品 点 通 部 回 度 位 倍 割 階
"""
HONORIFICS = """
    さん 先生 教授 准教授 講師 医師 医長 弁護士 司法書士 行政書士 税理士 会計士
    社長 専務 常務 部長 課長 係長 主任 所長
"""
#: 氏 is one too, but not in 氏名 and 氏族.
HONORIFIC_SHI, NOT_AFTER_SHI = "氏", "名族"
NO_JAPANESE_NAMES = """
    彼 彼女 皆 皆様 客 御客 顧客 疲 他 各 全 同 当 弊 貴 本 旧 新 元 前 後 先 現 上 中 下 大 小 代表
    担当 主治 責任 監督 指導 研修 実習 関係 従業 社員 職員 役員
"""
JAPANESE_LEGAL_FORMS = "株式会社 有限会社 合同会社 合資会社"
JAPANESE_ORGANISATIONS = "銀行 証券 保険 信託 商事 工業 建設 製作所 製薬 電機 運輸 組合"
JAPANESE_PARTICLES = "は が を に で と の へ も や から まで より および ならびに"
JAPANESE_PARTIES = "社方側"

# --- fixed values: Chinese ----------------------------------------------------------------------------------------------
CHINESE_CITED = "条款项章节编版次图表"
CHINESE_UNITS = """
    毫米 厘米 米 公里 千米 毫克 克 公斤 千克 吨 毫升 升
    平方厘米 平方米 平方公里 平方千米 立方厘米 立方米 亩
    秒 分 分钟 时 小时 天 周 月 年 年度
    人 名 位 个 件 只 条 台 辆 张 本 页 片 家 岁 次 倍 章
"""
CHINESE_MONEY = "元 人民币"
CHINESE_TITLES = """
    先生 女士 小姐 老师 教授 副教授 讲师 医生 医师 大夫 律师 会计师 工程师
    经理 总监 主任 部长 院长
"""
NO_CHINESE_NAMES = """
    上 下 前 后 新 旧 老 大 小 总 副 全 各 本 此 该 代理 执行 实习 主治 住院 门诊 专科 首席
    负责 责任 主管 指导 相关
"""
NOT_FIRST_IN_NAME = "该本此某各每诸全总副前后新旧老"
CONNECTORS = "的与和及由为是找请给"
NOT_IN_ORGANISATION = "的与和及由为是找请给在对向到从或"
NAME_PUNCTUATION = "，。、：；（）()"
CHINESE_ORGANISATIONS = "公司 有限公司 有限责任公司 股份有限公司 集团 银行 证券 保险 研究院 研究所 事务所"
CHINESE_PARTIES = "方 侧 公司"
