"""Fixed values of the extraction rules: component names, patterns and vendors as the reports write them, in order of precedence."""

from __future__ import annotations

# Parts of a teardown (component, class, patterns, what the part does).
PART_RULES = (
    ("蓝牙音频SoC", "core", (r"蓝牙音频\s*SoC", r"蓝牙主控"), "承担无线连接和音频处理"),
    ("音频编解码器/DSP", "core", (r"音频编解码器", r"音频编解码芯片", r"音频\s*DSP"), "承担音频编解码或数字信号处理"),
    ("微控制器", "core", (r"微控制器", r"\bMCU\b"), "承担整机控制"),
    ("电源管理芯片", "core", (r"电源管理芯片", r"\bPMIC\b"), "承担系统级充放电或电源管理"),
    ("电池", "core", (r"(?:锂电池|扣式电池|电池组|内置电池).{0,45}(?:mAh|mWh|型号)",), "系统能源器件，且原文给出型号或参数"),
    ("MEMS麦克风", "core", (r"MEMS麦克风",), "核心拾音器件"),
    ("VPU骨传导麦克风", "core", (r"VPU骨传导麦克风", r"骨传导麦克风"), "核心拾音器件"),
    ("动圈单元", "core", (r"动圈单元",), "核心发声器件"),
    ("动铁单元", "core", (r"动铁单元",), "核心发声器件"),
    ("扬声器/驱动单元", "core", (r"(?:扬声器|驱动单元).{0,25}(?:mm|发声)",), "核心发声器件"),
    ("电池保护IC", "key", (r"(?:锂电|电池)保护\s*IC",), "电池安全保护器件"),
    ("MOS管", "key", (r"MOS管", r"MOSFET"), "电源开关或保护器件"),
    ("热敏电阻", "key", (r"热敏电阻",), "电池温度检测器件"),
    ("自恢复保险丝", "key", (r"自恢复保险丝",), "输入过流保护器件"),
    ("TVS保护管", "key", (r"TVS保护管", r"TVS二极管"), "输入浪涌或过压保护器件"),
    ("LC双工器", "key", (r"LC双工器", r"双工器"), "射频收发隔离器件"),
    ("晶振", "key", (r"晶振",), "为主芯片提供时钟"),
    ("功率电感", "key", (r"功率电感",), "电源转换外围器件"),
    ("LDS天线", "key", (r"LDS(?:镭射)?天线",), "无线射频关键器件"),
    ("天线弹片", "key", (r"天线弹片", r"连接天线的金属弹片"), "连接射频天线"),
    ("Type-C接口", "auxiliary", (r"Type-C(?:充电)?(?:母座|接口)", r"USB-C(?:母座|接口)"), "标准外部接口"),
    ("Pogo Pin连接器", "auxiliary", (r"Pogo\s*Pin",), "标准充电连接器"),
    ("BTB连接器", "auxiliary", (r"BTB连接器",), "板对板连接器"),
    ("ZIF连接器", "auxiliary", (r"ZIF连接器",), "柔性排线连接器"),
    ("功能按键", "auxiliary", (r"(?:功能|配对)按键",), "标准人机交互器件"),
    ("指示灯/导光件", "auxiliary", (r"指示灯", r"导光(?:柱|件)"), "标准状态指示器件"),
    ("固定支架", "structure", (r"(?:固定|透明|电池|主板|座舱|座)支架", r"支架结构"), "纯机械承载或固定结构"),
    ("缓冲泡棉", "structure", (r"泡棉", r"缓冲棉"), "缓冲、密封或减振结构"),
    ("屏蔽罩", "structure", (r"屏蔽罩",), "机械屏蔽结构"),
    ("C形桥/硅胶结构", "structure", (r"C[形型].{0,8}桥", r"硅胶连接件"), "佩戴或连接结构"),
)
CLASS_LABELS = {"core": "核心BOM", "key": "关键BOM", "auxiliary": "辅助器件", "structure": "结构件", "unidentified_marking": "待识别丝印"}
UNKNOWN_PART = ("待识别器件", "unidentified_marking", "原文仅提供丝印，尚不足以确认器件类型或型号")

# Vendors of a teardown (display name, aliases).
PART_VENDORS = (
    ("GigaDevice兆易创新", ("GigaDevice", "兆易创新")),
    ("SinhMicro昇生微电子", ("SinhMicro", "昇生微电子")),
    ("AIROHA达发（络达）", ("AIROHA", "达发", "络达")),
    ("ZeniPower至力", ("ZeniPower", "至力")),
    ("紫建电子", ("紫建电子",)),
    ("SONY索尼", ("SONY", "索尼")),
    ("Cirrus Logic凌云逻辑", ("Cirrus Logic", "凌云逻辑")),
)

# Where a part sits, and how reports name that.
CASE_SIDE, EARBUD_SIDE = "充电盒", "耳机"
CASE_TERMS, EARBUD_TERMS = ("充电盒", "充电仓", "座舱"), ("耳机", "前腔", "后腔", "音腔", "腔体")
SIDE_BY_HEADING, SIDE_BY_CLAUSE = "依据报告章节标题", "章节未明确位置，依据当前证据句中的部位词"
SIDE_CONFLICT, SIDE_UNKNOWN = "同一证据句同时出现充电盒与耳机部位词，需要人工确认", "原文章节和证据句均未给出明确部位"
TEARDOWN_TERM, SUMMARY_TERM, SUMMARY_PARAGRAPH = "拆解", "总结", r"^(?:我爱音频网)?(?:拆解)?总结"

# Markings, models and specifications.
MARKING = r"(?iu)(?:丝印为|镭雕为|丝印|镭雕)\s*([A-Za-z0-9][A-Za-z0-9 ._/-]{0,24}?)(?=的|为|，|。|$)"
MARKED_PART = r"(?iu)(?:丝印|镭雕)\s*[A-Za-z0-9 ._/-]{1,24}的\s*(MEMS麦克风|VPU骨传导麦克风|骨传导麦克风|MOS管|TVS保护管|晶振|IC)"
MARKED_BUT_UNKNOWN = r"(?iu)(?:的|为)?\s*(?:IC|芯片|元件)(?:特写|。|，|$)"
NAMED_PARTS = ("MOS管", "TVS", "晶振", "麦克风", "SoC", "微控制器", "电源管理", "保护IC", "双工器", "电感", "电池", "连接器")
MICROPHONES = ("MEMS麦克风", "VPU骨传导麦克风")
BONE_MICROPHONE, VPU_MICROPHONE, BATTERY = "骨传导麦克风", "VPU骨传导麦克风", "电池"
EXPLICIT_MODEL = r"型号[：:]\s*([^，。；;]{2,40})"
MODEL_TOKEN = r"(?i)(?<![A-Za-z0-9])(?=[A-Z0-9-]{4,24}(?![A-Za-z0-9]))(?=[A-Z0-9-]*[A-Z])(?=[A-Z0-9-]*[0-9])[A-Z0-9-]+(?![A-Za-z0-9])"
NO_MODELS = ("TYPE-C", "USB-C", "CORTEX-M4", "CORTEX-M33F", "SRAM", "UART", "USART", "OTG")
PARAMETER_TOKEN = r"(?i)^[0-9]+(?:V|MAH|MWH|MHZ|KHZ|MM)$"
SPECIFICATION = r"(?iu)[0-9]+(?:\.[0-9]+)?\s*(?:mAh|mWh|Wh|MHz|kHz|KB|MB|mm|ohm|V|W|Ω)"

# Parts in the prose of a summary.
SIDE_ANCHORS = ((CASE_SIDE, r"(?:充电盒|充电仓|座舱)\s*(?:搭载|采用|内置|配备|设置|内部)"), (EARBUD_SIDE, r"耳机\s*(?:内部)?\s*(?:搭载|采用|内置|配备|设置)"))
CLAUSE_SIDES = ((CASE_SIDE, r"充电盒|充电仓|座舱"), (EARBUD_SIDE, r"耳机内部|耳机|左耳|右耳|腔体"))
CHIP_PATTERNS = (
    r"Qualcomm\s+[A-Z0-9\-]+", r"高通\s*[A-Z0-9\-]+", r"Actions\s+[A-Z0-9]+", r"络达\s*[A-Z0-9\-]+", r"恒玄\s*[A-Z0-9\-]+", r"BES\s*[A-Z0-9\-]+", r"JL\s*杰理科技\s*AC\d+[A-Z0-9]*", r"杰理科技\s*AC\d+[A-Z0-9]*",
    r"JL\d+", r"AB\d+", r"QCC\d+", r"INJOINIC\s*英集芯\s*IP\d+[A-Z]?", r"英集芯\s*IP\d+[A-Z]?", r"IP5528", r"IP5526", r"IP5516", r"Bluetrum\s*中科蓝讯\s*BT\d+[A-Z]?", r"中科蓝讯\s*BT\d+[A-Z]?", r"BT8912F", r"BT\d{4}[A-Z]",
    r"BES2700iH", r"BES\d{4}[a-zA-Z]*", r"思远半导体\s*SY\d+", r"SY8805", r"SY\d{4}", r"ConvenientPower\s*易冲半导体\s*CPS\d+", r"易冲半导体\s*CPS\d+", r"CPS4520", r"CPS\d{4}", r"XHSC\s*小华半导体\s*HC\d+[A-Z][A-Z0-9]+",
    r"小华半导体\s*HC\d+[A-Z][A-Z0-9]+", r"HC32L170FAUA", r"HC32L\d{3}[A-Z]+", r"WINSEMI\s*稳先微\s*WSDF\d+[A-Z]?", r"稳先微\s*WSDF\d+[A-Z]?", r"WSDF5317C", r"WSDF\d{4}[A-Z]", r"Prisemi\s*芯导\s*P\d+[A-Z]+\d?[A-Z]?",
    r"芯导\s*P\d+[A-Z]+\d?[A-Z]?", r"P14C1S", r"晶晨\s*A113X", r"A113X", r"AIC8800", r"爱科微\s*AIC\d+", r"昆腾\s*KT\d+[A-Z]?", r"KT0656M", r"KT\d{4}[A-Z]?", r"SS-?88[01]", r"ETA\d{4}[A-Z]?", r"CM\d{4}[A-Z]?", r"IP\d{4}[A-Z]?",
    r"WP-?\d{4}[A-Z]?", r"BES\d{3,}[A-Z0-9]*", r"CSU\d{2}[A-Z0-9]+", r"SY\d{4}[A-Z]?",
)
CHIP_BRANDS = (
    ("INJOINIC", "INJOINIC英集芯"), ("英集芯", "INJOINIC英集芯"), ("IP5528", "INJOINIC英集芯"), ("IP5526", "INJOINIC英集芯"), ("IP5516", "INJOINIC英集芯"), ("Bluetrum", "Bluetrum中科蓝讯"), ("中科蓝讯", "Bluetrum中科蓝讯"),
    ("BT8912F", "Bluetrum中科蓝讯"), ("BES", "BES恒玄科技"), ("恒玄", "BES恒玄科技"), ("SY", "思远半导体"), ("思远", "思远半导体"), ("CPS", "ConvenientPower易冲半导体"), ("易冲", "ConvenientPower易冲半导体"),
    ("HC32L", "XHSC小华半导体"), ("小华半导体", "XHSC小华半导体"), ("WSDF", "WINSEMI稳先微"), ("稳先微", "WINSEMI稳先微"), ("P14C1S", "Prisemi芯导"), ("芯导", "Prisemi芯导"), ("A113X", "晶晨"), ("晶晨", "晶晨"),
    ("AIC8800", "爱科微"), ("爱科微", "爱科微"), ("KT0656M", "昆腾"), ("昆腾", "昆腾"), ("Qualcomm", "Qualcomm高通"), ("高通", "Qualcomm高通"), ("QCC", "Qualcomm高通"), ("Actions", "Actions"), ("络达", "Airoha络达"), ("JL", "JL杰理"),
)
BRAND_PREFIXES = (
    "INJOINIC", "英集芯", "Bluetrum", "中科蓝讯", "BES", "恒玄", "ConvenientPower", "易冲半导体", "XHSC", "小华半导体", "WINSEMI", "稳先微", "Prisemi", "芯导", "Qualcomm", "高通", "Actions", "络达", "Airoha", "JL", "晶晨", "爱科微", "昆腾",
)
MODEL_CORE = r"(?i)[A-Z]{1,4}[0-9]+[A-Z0-9]*"
#: What a chip does: a pattern over the words around it, or over the chip itself, and the role.
CHIP_ROLES = (
    ("around", "主控芯片", "主控/蓝牙"), ("chip", "IP55(?:28|26|16)", "PMIC/充电仓管理"), ("around", "充电仓管理|电源管理芯片|pmic", "PMIC/充电仓管理"), ("around", "无线充电", "无线充电IC"),
    ("around", "(?s)保护.*ic|ic.*保护", "保护IC"), ("around", "mcu", "MCU"), ("around", "加速度传感器|传感器", "传感器"), ("chip", "^BT[0-9]|^BES[0-9]", "主控/蓝牙"), ("chip", "^WSDF|^P[0-9]+C", "保护IC"), ("chip", "^HC32L", "MCU"), ("chip", "^CPS", "无线充电IC"),
)
CHIP_PART, CHIP_ROLE = "芯片/模组", "主控/蓝牙"
BATTERY_CAPACITY, BATTERY_CAPACITY_ONLY = r"(?iu)([0-9]+(?:\.[0-9]+)?)\s*(?:V\s*/?|/)\s*([0-9]{2,4})\s*mAh", r"(?iu)([0-9]{2,4})\s*mAh"
BATTERY_VENDOR = r"(WEL旭航诚|HJ弘捷新能源|弘捷|微电新能源|鹏辉|宁德时代|比亚迪|国能|亿纬|赣锋)"
BATTERY_FORMS = (("软包", "扣式", "软包扣式"), ("钢壳", "扣式", "钢壳扣式"), ("锂", "锂", "锂电池"))
SPEAKER, SPEAKER_SIZE, SPEAKER_FORM, SPEAKER_DEFAULT = "喇叭单元", r"([0-9]+(?:\.[0-9]+)?)\s*mm\s*(?:对称双单元|双单元|动圈单元|动铁单元|单元|振膜)", r"(动圈单元|动铁单元|双单元|对称双单元|振膜动圈|黄金微晶振膜|钛振膜|生物振膜)", "动圈单元"
MICROPHONE, MICROPHONE_COUNT = "麦克风", r"(?iu)(两颗|双|三颗|三)?\s*(?:MEMS\s*)?麦克风"
COUNT_WORDS = {"两颗": "2", "双": "2", "三颗": "3", "三": "3"}

# Who makes a part. Vendors next to a part's noun (canonical name, aliases).
COMPACT_VENDORS = (
    ("JL杰理科技", ("珠海市杰理科技", "JL杰理科技", "JL杰理", "杰理科技", "杰理")),
    ("BES恒玄科技", ("BES恒玄科技", "BES恒玄", "恒玄科技", "恒玄")),
    ("Qualcomm高通", ("Qualcomm高通", "高通Qualcomm", "Qualcomm", "高通")),
    ("Bluetrum中科蓝讯", ("Bluetrum中科蓝讯", "中科蓝讯", "Bluetrum")),
    ("Actions炬芯", ("Actions炬芯", "炬芯", "Actions")),
    ("Realtek瑞昱", ("REALTEK瑞昱", "Realtek瑞昱", "REALTEK", "Realtek", "瑞昱")),
    ("Airoha络达", ("AIROHA络达", "Airoha络达", "AIROHA", "Airoha", "络达")),
    ("INJOINIC英集芯", ("INJOINIC英集芯", "INJOINIC", "英集芯")),
    ("ConvenientPower易冲半导体", ("ConvenientPower易冲半导体", "ConvenientPower", "易冲半导体")),
    ("XHSC小华半导体", ("XHSC小华半导体", "XHSC", "小华半导体")),
    ("WUQI物奇", ("WUQI物奇", "WUQi物奇", "WUQI", "WUQi", "物奇")),
    ("BEKEN博通集成", ("BEKEN博通集成", "BEKEN", "博通集成")),
    ("UNISOC紫光展锐", ("UNISOC紫光展锐", "UNISOC", "紫光展锐")),
    ("思佳讯", ("思佳讯",)),
    ("旭化成", ("旭化成",)),
    ("NXP恩智浦", ("NXP恩智浦", "恩智浦")),
    ("微源半导体", ("LPS微源半导体", "LPS微源", "微源半导体", "微源")),
    ("昇生微电子", ("SinhMicro昇生微电子", "昇生微电子", "昇生微")),
    ("泉声电子", ("泉声电子",)),
)
COMPONENT_NOUN = (
    r"(?iu)(?:蓝牙(?:音频)?\s*(?:SoC|主控(?:芯片)?)|音频\s*(?:SoC|DSP)|无线音频(?:传输|发送|接收)?\s*(?:IC|芯片|接收器)|音频芯片|"
    r"(?:充电|电源|电池保护|过压过流保护|触控|降噪|射频|传感器|存储|功放)(?:管理)?\s*(?:SoC|IC|芯片)|可编程升压\s*(?:IC|芯片)|(?:MCU|DSP|SoC|主控芯片|芯片|存储器|稳压器))"
)
COMPACT_MODEL = r"(?iu)^[\s的]*[A-Z][A-Z0-9._/-]{2,28}[\s，,:：、-]*"
MODEL_ENDS_IN_NOUN = r"(?iu)(?:MCU|DSP|SoC|IC)[\s，,:：、-]*$"
NOUN_BEFORE, NOUN_AFTER, NOUN_BEHIND_MODEL = 28, 104, 88
MAKER_PATTERNS = (r"(生产厂家|生产厂商?|生产厂|生产商|制造商|供应商)(?:来自|为|是|：|:)?\s*([^，。；;]{2,80})", r"(来自|源自)\s*([^，。；;]{2,80})")
BATTERY_MAKER = r"(?iu)(?:采用|使用|搭载)(?:了)?\s*([A-Za-z0-9\u4e00-\u9fff（）()·& .-]{2,50})的(?:钢壳|扣式|锂离子|锂聚合物|聚合物锂离子)?电池"
BATTERY_CELL = (
    r"(?iu)(?:(?:内置|搭载|采用|使用|配备|装有)[^，。；]{0,24}(?:锂离子|锂聚合物|聚合物锂离子|钢壳|扣式|软包)?电池(?:组|标签)?|(?:电池组|电池标签|扣式电池|钢壳电池)|"
    r"电池[^。；]{0,55}(?:额定容量|标称电压|充电限制电压|[0-9]+(?:\.[0-9]+)?\s*(?:mAh|Wh)))"
)
PRODUCT_LABEL, PRODUCT_LABEL_FAR = r"(?:产品名|产品型号|耳机型号|充电盒型号|盒盖内侧|产品信息)", r"(?:产品名|耳机型号|充电盒型号|盒盖内侧|产品信息)"
CELL_MAKER, CHIP_RELATION, MAKER, FROM = r"电池(?:组)?[^。；]{0,30}制造商", r"(?iu)(?:IC|芯片|SoC|电感|充电管理|电源管理)", "制造商", ("来自", "源自")
BEFORE_MAKER = 180
NO_MAKERS = ("未知", "不详", "供应商", "生产商", "制造商", "电池", "锂电池", "原厂", "钢壳扣式", "软包扣式", "扣式", "钢壳", "锂离子", "锂聚合物")

# Labelled parameters of a part (label, words that are in every match, pattern with the value as its group).
PARAMETER_RULES = (
    ("最高主频", "最高主频", r"最高主频(?:为|：|:)?\s*([0-9]+(?:\.[0-9]+)?\s*MHz)"),
    ("片上闪存", "片上闪存", r"(?:高达)?\s*([0-9]+(?:\.[0-9]+)?\s*KB)\s*的?片上闪存"),
    ("SRAM", "SRAM", r"([0-9]+(?:\.[0-9]+)?\s*KB)\s*SRAM"),
    ("额定容量", "额定容量", r"额定容量[：:]?\s*([0-9]+(?:\.[0-9]+)?\s*mAh)"),
    ("额定能量", "额定能量", r"额定能量[：:]?\s*([0-9]+(?:\.[0-9]+)?\s*mWh|[0-9]+(?:\.[0-9]+)?\s*Wh)"),
    ("标称电压", "标称电压", r"标称电压[：:]?\s*([0-9]+(?:\.[0-9]+)?\s*V)"),
    ("充电限制电压", "充电限制电压", r"充电限制电压[：:]?\s*([0-9]+(?:\.[0-9]+)?\s*V)"),
    ("OVP耐压", "OVP", r"([0-9]+(?:\.[0-9]+)?\s*V)\s*耐压\s*OVP"),
    ("驱动单元尺寸", "高性能驱动单元", r"([0-9]+(?:\.[0-9]+)?\s*mm)\s*高性能驱动单元"),
    ("实测直径", "直径约", r"直径约(?:为)?\s*([0-9]+(?:\.[0-9]+)?\s*mm)"),
    ("处理器内核", "Cortex-", r"(Arm\s+Cortex-[A-Za-z0-9]+(?:\s+RISC内核)?)"),
    ("主要用途", "用于", r"(用于[^。；;]{3,80})"),
    ("集成功能", "集成", r"(集成了?[^。；;]{3,100})"),
    ("接口资源", "USART+UART", r"(集成了?\s*USART\+UART[^。；;]{3,120})"),
)

# Materials, the nouns of parts that they are tied to, and the words that tie them.
MATERIALS = ("液态硅胶", "硅胶", "铝合金", "不锈钢", "镀镍钢壳", "钢壳", "铜箔", "铜", "陶瓷", "石墨", "泡棉", "塑料", "聚碳酸酯", "PC+ABS", "PC", "ABS", "PET", "TPU")
SHORT_MATERIALS = ("PC+ABS", "PC", "ABS", "PET", "TPU")
MATERIAL_LABELS, COMPONENT_NOUNS = ("材料", "材质"), ("电池", "天线", "外壳", "壳体", "支架", "泡棉", "振膜", "扬声器", "喇叭", "动圈", "动铁", "麦克风", "连接器", "线圈", "主板", "电路板", "PCB", "按键")
MADE_OF, MADE_INTO = "[^，。；]{0,10}(?:采用|使用|材质|材料|由|制成|为)[^，。；]{0,12}", "(?:材质|材料)?(?:制成的?|的)?[^，。；]{0,6}"
SHORT_MATERIAL_BEFORE, SHORT_MATERIAL_BEHIND = "(?:采用|使用|材质|材料|制成|壳体)[^，。；]{0,16}", "[^，。；]{0,8}(?:材质|材料|壳)"
LONGEST_EVIDENCE = 500

# Component families of captions (family, pattern over the text without marks and spaces; an empty family ends the search).
CAPTION_MARKS = r"[\s，。！？；：、,.!?;:'\"‘’“”·—_-]+"
CAPTION_FAMILIES = (
    ("battery_protection", "过压|过流|保护ic|充电器前端保护|电池过压"), ("", "麦克风放大器|接收器放大器"), ("wireless_audio", "无线音频(?:传输|接收|收发)|无线音频.*ic"), ("audio_codec", "音频芯片|音频编解码"), ("memory", "存储器|储存器"),
    ("mcu", "mcu|微控制器"), ("bluetooth_audio_soc", "蓝牙音频(?:soc|主控|芯片)"), ("power_management", "电源管理(?:soc|ic|芯片)|可编程升压|升压ic"), ("sensor", "霍尔(?:元件|传感器)"), ("regulator", "稳压器"),
    ("speaker", "扬声器|喇叭"), ("microphone", "麦克风"), ("battery", "电池"),
)
CAPTION_IDENTITY = r"^(?:这是|型号|丝印)|(?:制造商|生产商|供应商)"
CAPTION_CONTINUES = (
    r"^(?:型号|丝印|制造商|生产商|供应商|额定|标称|充电限制|工作频率|生产厂|来自|源自|据.+来自|用于|负责|采用|容量|电压|电流|功率|阻抗|尺寸|"
    r"标.*电压|同时支持|支持|在电池|是一款|是(?:四|双|单)通道|最大|超高|立体声|和立体声|内置.+放大器)"
)
CAPTION_MODEL = r"(?<![A-Za-z0-9])(?=[A-Za-z0-9-]{4,})(?=[A-Za-z0-9-]*[A-Za-z])(?=[A-Za-z0-9-]*[0-9])[A-Za-z0-9][A-Za-z0-9-]{3,}(?![A-Za-z0-9])"
PARAMETER_SHAPED = r"(?i)^[0-9]+(?:\.[0-9]+)?(?:mAh|Ah|mWh|Wh|mV|V|mm|Hz|kHz|MHz|GHz|mW|W)$"
DIMENSION_SHAPED = r"(?i)^[0-9]+(?:\.[0-9]+)?\s*[x×*]\s*[0-9]+(?:\.[0-9]+)?$"
LABELLED_NUMBER, CORE_NAME, MODEL_SUFFIX, NO_CAPTION_MODELS = r"型号\s*[：:]?\s*([0-9]{5,})", "cortex", r"(?i)(?:MCU|SOC|IC)$", ("type-c", "usb-a")
GENERIC_MODELS = ("芯片", "模组", "电池", "扬声器", "喇叭", "麦克风", "存储器", "储存器", "稳压器", "接收器", "mcu", "soc", "ic")
CAPTION_SIDES = ((CASE_SIDE, ("充电盒", "充电仓", "座舱", "盒体")), (EARBUD_SIDE, ("耳机", "左耳", "右耳", "耳塞", "前腔", "后腔")))
CAPTION_PARAMETERS = (
    ("容量", r"[0-9]+(?:\.[0-9]+)?\s*(?:mAh|毫安时)", 0), ("能量", r"[0-9]+(?:\.[0-9]+)?\s*(?:Wh|瓦时)", 0), ("电压", r"[0-9]+(?:\.[0-9]+)?\s*(?:mV|V|伏)", 0),
    ("尺寸", r"(?:尺寸(?:为)?\s*[：:]?\s*)?([0-9]+(?:\.[0-9]+)?\s*(?:mm|毫米)|[0-9]+(?:\.[0-9]+)?\s*[x×*]\s*[0-9]+(?:\.[0-9]+)?)", 1), ("频率", r"[0-9]+(?:\.[0-9]+)?\s*(?:kHz|MHz|GHz|Hz)", 0),
    ("功率", r"(?:(?:额定|充电|最大短时)?功率(?:约为)?\s*[：:]?\s*)([0-9]+(?:\.[0-9]+)?\s*(?:毫瓦|瓦(?!时)))|[0-9]+(?:\.[0-9]+)?\s*(?:mW|W)", 1), ("阻抗", r"[0-9]+(?:\.[0-9]+)?\s*(?:kΩ|Ω|ohm)", 0),
)

# Keys of components (key, markers in the name without spaces), and those that are analysed (key, label, class).
COMPONENT_RULES = (
    ("battery_protection_ic", ("电池保护芯片", "电池保护ic", "锂电保护", "保护ic")), ("battery", ("电池", "锂离子", "锂聚合物")), ("speaker_driver", ("扬声器", "喇叭", "发声单元", "驱动单元", "动圈单元", "动铁单元", "振膜")),
    ("microphone", ("麦克风", "mic", "mems")), ("bluetooth_audio_soc", ("蓝牙音频soc", "蓝牙soc", "主控soc", "蓝牙主控")), ("wireless_audio_ic", ("无线音频传输ic", "无线音频发送ic", "无线音频接收器", "无线音频接收芯片")),
    ("audio_codec_dsp", ("音频编解码器", "音频编解码芯片", "音频dsp", "音频芯片")), ("mcu", ("微控制器", "mcu")), ("power_management_ic", ("电源管理芯片", "电源管理ic", "电源管理soc", "pmic", "稳压器", "可编程升压ic")),
    ("charging_ic", ("充电管理芯片", "充电芯片", "charger")), ("overvoltage_protection", ("tvs保护", "过压保护", "ovp")), ("wireless_charging_ic", ("无线充电芯片", "无线充电ic")), ("mosfet", ("mos管", "mosfet")),
    ("sensor", ("传感器", "加速度计", "陀螺仪", "霍尔")), ("memory", ("存储器", "储存器", "flash", "eeprom")), ("crystal_oscillator", ("晶振", "晶体振荡器")), ("antenna", ("天线",)),
    ("connector", ("连接器", "连接座", "排线", "fpc", "弹片触点", "充电触点", "type-c", "typec", "usb-c")), ("pcb", ("pcb", "主板", "小板", "电路板")), ("indicator", ("指示灯", "导光", "led")), ("button", ("按键", "按钮")), ("fuse", ("保险丝",)),
    ("enclosure", ("外壳", "壳体", "上盖", "下盖", "腔体")), ("structural_support", ("支架", "固定架", "钢架", "转轴", "铰链")), ("generic_chip_module", ("芯片/模组", "芯片模组", "芯片模块")),
)
ANALYSED = (
    ("battery", "电池", "core"), ("speaker_driver", "扬声器/发声单元", "core"), ("microphone", "麦克风", "auxiliary"), ("bluetooth_audio_soc", "蓝牙音频 SoC", "core"), ("wireless_audio_ic", "无线音频收发 IC", "core"), ("audio_codec_dsp", "音频编解码 / DSP", "core"),
    ("mcu", "微控制器 MCU", "core"), ("power_management_ic", "电源管理 IC", "core"), ("charging_ic", "充电管理 IC", "core"), ("battery_protection_ic", "电池保护 IC", "auxiliary"), ("overvoltage_protection", "过压保护 IC", "auxiliary"), ("sensor", "传感器", "auxiliary"),
    ("memory", "存储器", "auxiliary"), ("connector", "连接器/排线", "auxiliary"), ("pcb", "PCB/电路板", "auxiliary"), ("enclosure", "外壳/壳体", "structure"), ("structural_support", "支架/转轴", "structure"),
)

# Where a video's summary begins, and what its facts are about.
SUMMARY_STRONG = (r"附上.*(?:已知|核心|参数|信息)", r"(?:最后|下面).*(?:总结|回顾)", r"总结(?:一下|如下)")
SUMMARY_WEAK, SUMMARY_OUTRO, SUMMARY_OPENING = (r"(?:内部)?主要配置(?:上|方面)", r"以上就是.*拆解", r"最后来看"), "以上就是", r"主要配置(?:上|方面)|最后来看"
SUMMARY_FROM = 0.55
SECTION_RULES = (("unboxing_packaging", "包装|配件|充电线|音频线"), ("unboxing_charging_case", "充电盒|充电仓|盒体"), ("unboxing_earbuds", "外观|头梁|头垫|耳罩|佩戴|倾斜结构|表面材质"), ("market", "兼容|游戏|音效|连接方式|便捷|舒适|人体|人耳"))
TOPICS = ("佩戴体验", "音质体验", "通话体验", "续航充电", "连接与智能", "耐用防护", "外观设计")
TOPIC_RULES = (("佩戴体验", "佩戴|舒适|人体|人耳"), ("音质体验", "音效|音质|声"), ("通话体验", "通话|麦克风"), ("续航充电", "续航|充电|电量"), ("耐用防护", "(?i)防水|防尘|耐用|IPX"), ("连接与智能", "连接|兼容|游戏|接口"))
TOPIC_DEFAULT, SCENARIOS, THREE_SECTIONS = "外观设计", ("游戏",), ("耳夹式耳机", "耳挂式耳机", "全入耳式耳机", "半入耳式耳机")

# Specifications and parts lists in text read from images (part, pattern, unit, confidence).
IMAGE_SPECS = (
    ("电池", r"([0-9]+)\s*mAh", "mAh", 0.85), ("尺寸", r"([0-9]+(?:\.[0-9]+)?)\s*mm", "mm", 0.7), ("重量", r"([0-9]+(?:\.[0-9]+)?)\s*(?:g|克)", "g", 0.75), ("防护等级", r"(IP\s*X?[0-9]{1,2})", "", 0.9), ("充电接口", r"(Type-?C)", "", 0.85),
    ("蓝牙", r"蓝牙[^0-9]*V?([0-9]\.[0-9]+)", "", 0.85), ("蓝牙", r"Bluetooth\s*V?([0-9]\.[0-9]+)", "", 0.85),
)
LIST_CELLS, LIST_CHIP, LIST_CHIP_MODEL = r"[\t|｜]+", r"(?:INJOINIC英集芯|英集芯|Bluetrum中科蓝讯|中科蓝讯|Qualcomm高通|BES恒玄|恒玄|JL杰理|杰理|SY[0-9]+|IP[0-9]+|BT[0-9]+)[^\n，。；]*", r"(?iu)([A-Z]{1,4}[0-9]+[A-Z0-9]*)"
LIST_VENDOR, LIST_ROWS, POWER_ROLE = r"([A-Za-z一-鿿]{2,12})", 40, "PMIC/充电仓管理"

# Sentences by their words (name, words, pattern beside the words, most of a text), and words of packaging.
TECH_FIELDS = (
    ("charging_method", ("充电方式", "无线充电", "有线充电", "磁吸充电", "跟随充电")), ("charging_port", ("充电接口", "Type-C", "Type C", "Micro USB", "Lightning")), ("manual_notes", ("说明书", "使用说明", "警示", "使用手册")),
    ("product_markings", ("额定输入", "额定电压", "型号：", "型号:", "认证", "3C", "CE", "FCC", "频响范围", "防护等级", "IP")),
)
PACKAGING_WORDS = ("包装盒", "配件一览", "说明书", "外包装", "配件物品", "产品手册", "包装背面", "包装正面")
PORT_PATTERNS = (r"Type-?C", r"Micro\s?USB", r"Lightning", r"USB-?A")
SENTENCE_FILTERS = (
    ("supply_hints", ("供应商", "代工", "模组厂", "原厂", "采购", "供应链", "方案商", "器件商"), "", 5),
    ("fasteners", ("螺丝", "螺钉", "卡扣", "卡榫", "卡槽", "胶粘", "胶水", "超声焊接", "热熔", "卡接", "固定卡"), "", 5),
    ("sealing", ("密封圈", "O型圈", "防水胶", "点胶", "超声熔接", "防水涂层", "密封胶", "防尘网"), r"(?i)IP\s*X?[0-9](?![0-9])", 5),
    ("wear", ("佩戴", "耳挂", "耳夹", "头梁", "耳塞", "舒适"), "", 4),
    ("structure", ("内部", "腔体", "结构", "固定", "组装", "拆解", "焊接", "点胶"), "", 8),
)

# Forms of earphones (label, pattern), in which a product may be said to differ from what it was.
FORM_LABELS = (
    ("ear_clip", r"耳夹式|耳夹耳机|耳夹设计|夹耳式|夹耳耳机|夹耳设计|夹持(?:在)?耳廓"), ("ear_hook", r"耳挂式|挂耳式|耳挂耳机|挂耳耳机|耳挂设计|挂耳设计|挂在耳廓|绕(?:在)?耳廓|耳钩"), ("semi_in_ear", r"半入耳式|半入耳"),
    ("full_in_ear", r"全入耳式|全入耳|(?<!半)入耳式|豆(?:状|式)入耳设计|柄(?:状|式)入耳设计"), ("headphone", r"头戴式.{0,8}耳机|头戴耳机|头戴式设计"), ("neckband", r"颈挂式.{0,8}耳机|颈挂耳机|脖挂.{0,8}耳机|项圈(?:式)?.{0,8}耳机"),
    ("wired", r"有线耳机|Lightning(?:接口)?耳机|USB[- ]?C(?:接口)?耳机|(?:产品名称|佩戴方式).{0,100}(?:Lightning|USB[- ]?C)接口|(?:Lightning|USB[- ]?C)接口.{0,30}(?:主动降噪|入耳式)?耳机|耳机.{0,40}(?:Lightning|USB[- ]?C)接口直接供电"),
    ("bone_conduction", r"骨传导(?:蓝牙)?耳机|骨传导设计"),
)
FIXED_FORMS, FIRST_FORMS = ("bone_conduction", "headphone", "neckband", "wired"), ("ear_clip", "ear_hook")
FORM_CHANGE, FORM_CONTRAST = r"(?iu)(?:由|从).{0,40}?(?:改为|变为|升级为|转为|更换为)(.{1,60})", r"(?iu)(?:但|实际(?:上)?|佩戴时)(.{1,60})"

# Modules of an unboxing, what is left out of them, and words of the digest of a roundup.
TEARDOWN_WORDS, GENERIC_CAPTIONS, REPORT_TITLE = ("拆解", "主板", "芯片", "电路", "焊接", "屏蔽罩", "电池保护", "丝印", "镭雕"), ("外观一览", "特写", "拆解报告"), "拆解报告："
BULLET_NUMBER, BULLET_TOPIC, FINDING, ARTICLE_IMAGE = r"(?iu)[0-9]+(?:\.[0-9]+)?\s*(?:mAh|mWh|Wh|W|V|mm|h|小时|分钟|g|%|倍)", "外观与配置", "关键发现", "原文配图"

# Sources of records (source, layer, name, whether it is in use), and the layers by trust.
SOURCES = (("audio52", "technical", "拆解报告", True), ("channel_multi", "channel", "电商渠道", True), ("official_consumer", "official", "品牌官网产品页", True), ("review_stub", "review", "媒体评测", False))
LAYER_PRIORITY = {"technical": 4, "official": 3, "channel": 2, "review": 1}

# Predicates over titles, parts, prices, sentences and names.
ROUNDUP_MARKERS, HEADPHONE_MARKERS = ("汇总", "盘点", "年度报告", "给你答案"), ("耳机", "TWS", "OWS", "蓝牙")
CASE_STUDY_MARKERS, YEAR_IN_TITLE, YEARLY_WORD = ("应用案例", "方案", "芯片", "电感"), "20[0-9]{2}", "年度"
ROUNDUP_KINDS = ("方案案例", "年度汇总", "品类汇总")
CONCRETE_PART = (
    "(?iu)芯片|SoC|MCU|微控制器|处理器|电池|扬声器|喇叭|动圈|动铁|麦克风|传感器|主板|PCBA|PCB|FPC|天线|连接器|连接线|排线|插座|接口|线圈|磁铁|马达|LED|指示灯|按键|触控板|触控芯片|支架|转轴|铰链|网罩|声学网|耳套|外壳"
)
PACKAGING_EVIDENCE, NO_PARTS, LONGEST_UNNAMED = ("包装盒", "包装清单", "外包装"), ("降噪系统", "触控/按键", "功能", "佩戴体验", "音质"), 220
AUTOMATIC_PRICES, AUTOMATIC_PREFIX = ("jd", "jd_api", "jd_union", "jd_hint", "zol_reference"), "zol_"
TECH_WORDS = (
    "芯片", "SoC", "主控", "蓝牙", "Bluetooth", "LDAC", "aptX", "LHDC", "AAC", "SBC", "QCC", "AB15", "BES", "恒玄", "络达", "高通", "Qualcomm", "Actions", "JL", "固件", "OTA", "多点连接", "一拖二", "蓝牙5", "蓝牙 5", "编解码",
)
BLUETOOTH_VERSION, CODEC, CODEC_BENEFITS = r"蓝牙\s*[0-9]\.[0-9]", "(?iu)(LDAC|aptX|LHDC|AAC|SBC)", ("认证", "支持", "获得", "体验", "带来")
COMPARISON_MARKERS, LONGEST_MODEL = ("对比", "汇总", "盘点", "top", "合集"), 48
MEDIA_NAME, VIDEO_ID, VIDEO_MEDIA_NAME = r"^[a-f0-9]{16}\.webp$", "^[A-Za-z0-9_.-]{1,64}$", r"^[a-f0-9]{16}\.(?:jpe?g|png|webp)$"
TRUSTED_CATEGORIES, TRUSTED_LOCATIONS = ("耳夹式耳机", "耳挂式耳机", "全入耳式耳机", "半入耳式耳机", "头戴式耳机", "骨传导耳机", "颈挂式蓝牙耳机", "有线耳机"), ("耳机", "充电盒")

# What becomes of a discovered video, and why.
SURE, INVENTORY_ROWS, ACTIVE_STATUSES, OPEN_STATUSES = 0.92, 5, ("queued", "processing", "ready", "published"), ("discovered", "failed")
