"""Term lists of the market relevance cascade, by rule."""

# Every list of this module.

# Words that are a market signal alone.
STRONG = (
    "guidance", "revenue", "earnings", "fund", "funds", "portfolio", "holdings", "tariff", "policy", "regulation", "acquisition", "merger", "outlook",
    "shares", "stock", "stocks", "profit", "forecast", "rates", "bank", "fed", "ipo",
)
# Words that need a sector beside them.
WEAK = (
    "demand", "supply", "shipment",
)
# Phrases that are a market signal.
PHRASES = (
    "sec proposes", "sec announces enforcement", "fund portfolio holdings", "reporting of fund", "buyback", "dividend", "share repurchase",
)
# Words that make a sector's news relevant.
SECTOR_TRIGGERS = (
    "guidance", "orders", "order", "demand", "supply", "shipments", "shipment", "outlook", "tariff", "policy", "regulation", "earnings", "revenue",
    "recovery", "export", "controls",
)
# Monetary policy.
MONETARY = (
    "降准", "存款准备金率", "降息", "加息", "减息", "利率决议", "基准利率", "政策利率", "贷款市场报价利率", "逆回购", "正回购", "中期借贷便利", "常备借贷便利", "公开市场操作", "货币政策", "量化宽松", "缩表", "国债收益率",
    "人民币中间价", "中间价", "汇率", "流动性投放",
)
# Macro data.
MACRO = (
    "居民消费价格", "消费者物价", "生产者物价", "工业生产者出厂价格", "国内生产总值", "采购经理指数", "社会融资规模", "广义货币", "失业率", "非农", "初请失业金", "工业增加值", "固定资产投资", "社会消费品零售", "进出口", "贸易顺差",
    "贸易逆差", "通胀", "通缩", "经济数据", "同比上涨", "同比下降", "同比增长", "同比下滑", "环比上涨", "环比下降", "环比增长",
)
# Regulators and exchanges.
REGULATORS = (
    "证监会", "银保监", "金融监管总局", "人民银行", "央行", "发改委", "财政部", "商务部", "工信部", "国资委", "国家统计局", "外汇管理局", "发展改革委", "上交所", "深交所", "北交所", "港交所", "交易所", "美联储", "欧洲央行",
    "日本央行", "英国央行", "上市公司", "监管新规", "监管机构", "证券法", "国务院常务会议",
)
# Trade.
TRADE = (
    "关税", "加征关税", "反倾销", "反补贴", "出口管制", "实体清单", "制裁", "贸易战", "贸易摩擦", "禁运", "出口配额", "供应链", "外贸", "出口信用保险",
)
# Corporate actions.
CORPORATE = (
    "业绩快报", "业绩预告", "业绩说明会", "净利润", "营业收入", "毛利率", "财报", "年报", "季报", "中报", "回购股票", "股份回购", "派息", "分红", "股东大会", "股东会", "股东减持", "股东增持", "股东变更", "股东权益",
    "股东回报", "股东名册", "股东提案", "控股股东", "大股东", "老股东", "新股东", "主要股东", "减持", "增持", "定向增发", "配股", "并购", "重组", "要约收购", "借壳", "退市", "停牌", "复牌", "招股", "上市申请",
    "商誉减值", "自由现金流", "资本开支", "上调指引", "营收指引", "上调资本开支", "召回", "停产", "涨价", "提价", "调价", "中标", "签订合同", "收购", "要约", "裁员", "破产", "违约", "爆雷", "增资", "增发", "举牌",
    "股权转让", "问询函", "立案调查", "行政处罚", "被约谈", "断供", "专利诉讼", "集体诉讼",
)
# Recalls that are no product recalls.
RECALL_FRIENDS = (
    "召回大使", "召回驻", "召回其", "召回外交",
)
# Sectors and commodities.
COMMODITIES = (
    "原油", "布伦特", "期货", "现货黄金", "黄金价格", "白银", "沪铜", "铁矿石", "螺纹钢", "碳酸锂", "电池级碳酸锂", "多晶硅", "光伏", "半导体", "晶圆", "新能源汽车", "储能", "房地产", "楼市", "煤炭", "天然气",
    "减产", "增产", "产能过剩",
)
# Market action.
MARKET_MOVES = (
    "沪指", "深成指", "创业板指", "科创板", "恒生指数", "道琼斯", "纳斯达克", "标普500", "股指", "北向资金", "南向资金", "成交额", "成交量", "总市值", "龙虎榜", "收盘上涨", "收盘下跌", "新股上市", "市场稳定计划",
)
# Broad names of markets.
BROAD = (
    "港股", "a股", "大盘",
)
# Context that the broadest name needs.
US_CONTEXT = (
    "盘前", "盘后", "开盘", "收盘", "收涨", "收跌", "涨超", "跌超", "上涨", "下跌", "普跌", "普涨", "三大指数", "期指", "熔断", "涨幅", "跌幅", "市值", "上市", "停牌",
)
# Titles of digests.
DIGEST_TITLES = (
    "点1氪", "氪星晚报", "早报", "晚报", "早知道", "热点导览", "要闻汇总", "新闻汇总", "每日精选",
)
# Macro acronyms.
ACRONYMS = (
    "cpi", "ppi", "gdp", "pmi", "lpr", "mlf", "opec", "fomc", "boj", "pboc",
)
# Noise.
NOISE = (
    "娱乐圈", "明星", "演唱会", "综艺", "电影票房", "影视剧", "八卦", "恋情", "结婚", "离婚", "球队", "球员", "联赛", "夺冠", "进球", "奥运", "世界杯", "天气预报", "气温", "降雨", "暴雨", "高温预警", "旅游攻略",
    "美食", "菜谱", "星座", "彩票",
)
# Concepts.
CONCEPTS = (
    "概念", "板块",
)
# Their moves.
MOVES = (
    "涨停", "跟涨",
)
# Product reviews.
GENERIC_TECH = (
    "camera", "reviewers", "display", "battery", "gaming", "smartphone", "laptop", "hands-on", "benchmark",
)
# Shipping.
SHIPPING_ROUTES = (
    "shipper", "shippers", "shipping", "container", "operators",
)
# Its disruptions.
SHIPPING_DISRUPTIONS = (
    "red sea", "route", "routes", "targeting",
)
# Strait tensions.
TAIWAN = (
    "对台", "台湾", "台海",
)
# Arms sales.
ARMS = (
    "军售", "导弹", "武器",
)
# Gulf tensions.
IRAN = (
    "伊朗",
)
# Military action.
MILITARY = (
    "军事行动", "动武", "军事打击", "空袭", "袭击",
)
# War powers.
WAR_POWERS = (
    "战争权力", "议案", "参议院", "投票", "否决",
)
# Acts against carriers.
GEO_ACTIONS = (
    "封锁", "袭击", "打击", "扣押", "禁运", "断航", "关闭海峡", "空袭", "轰炸", "击沉", "布雷", "拦截", "停航",
)
# Energy and shipping carriers.
CARRIERS = (
    "港口", "航道", "海峡", "油轮", "商船", "货轮", "船只", "船舶", "集装箱船", "航线", "管道", "lng", "液化天然气", "原油", "天然气", "炼油厂", "输油", "油田", "航运", "海运", "码头",
)
# Changes of status.
STATUS_CHANGES = (
    "恢复", "复航", "重开", "解封", "停航", "断航", "停运", "停止作业", "暂停作业", "停止装卸", "暂停装卸", "停止通行", "暂停通行", "禁止通行", "封港", "封锁", "关闭", "中断",
)
# Further carriers whose status may change.
MORE_CARRIERS = (
    "运河", "海上航行", "海上运输", "海上通道", "海上航线", "水道", "泊位", "锚地", "港区", "港务",
)
# Anchors of the sectors.
AI = (
    "ai", "gpu", "nvidia", "accelerator", "accelerators",
)
CHIPS = (
    "chip", "chips", "chipmaker", "chipmakers", "semiconductor", "semiconductors", "wafer",
)
INTERNET = (
    "tencent", "alibaba", "meituan", "jd", "baidu", "pdd", "netease", "gaming", "internet",
)
APPLE = (
    "apple", "iphone", "ipad", "macbook", "airpods", "display", "camera", "lens", "consumer", "electronics", "supplier", "suppliers",
)
# Words near an anchor that make a text one of the sector.
SECTORS = {
    "ai_compute": (AI, ("ai", "gpu", "server", "compute", "accelerator", "nvidia")),
    "semiconductors": (CHIPS, ("chip", "chips", "semiconductor", "export controls", "wafer")),
    "chinese_internet": (INTERNET, ("tencent", "alibaba", "meituan", "jd", "baidu", "internet", "gaming")),
    "apple_supply_chain": (APPLE, ("apple", "iphone", "display", "camera", "supplier", "consumer electronics")),
}
# Phrases that are anchors as well.
ANCHOR_PHRASES = {"ai_compute": ("ai server", "ai servers")}
