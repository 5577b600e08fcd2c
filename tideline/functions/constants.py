"""They must equal the published rules for equal results."""

# Legal suffixes of company names, in the order they are tried.
COMPANY_SUFFIXES = ["股份有限公司", "有限责任公司", "有限公司", "集团股份有限公司", "集团有限公司", "控股股份有限公司", "控股有限公司", "集团", "股份", "公司"]
# Words too common to be an alias.
AMBIGUOUS_ALIASES = ["中国", "中信", "中金", "中航", "中车", "中铁", "中电", "国电", "国投", "招商", "华能", "华电", "华润", "华夏", "东方", "光大", "兴业", "广发", "长城", "长江", "太平洋"]
# Words taken out of a company name for its variants, in order.
NAME_STOPWORDS = ["股份有限公司", "有限责任公司", "有限公司", "集团股份有限公司", "集团有限公司", "集团", "公司"]
# Source types that publish about one company.
DIRECT_SOURCES = ["sina_finance_company_news", "10jqka_public_stockpage_news", "aastocks_hk_stock_news", "hkexnews_announcement", "tdnet_jpx_disclosure"]
# Priority by source type; others have 10.
SOURCE_PRIORITY = {
    "hkexnews_announcement": 36.0,
    "aastocks_hk_stock_news": 34.0,
    "sina_finance_company_news": 32.0,
    "10jqka_public_stockpage_news": 28.0,
    "eastmoney_stock_news_search": 18.0,
    "google_news_rss": 18.0,
    "google_news_rss_company_query": 18.0,
    "google_news_rss_event_query": 14.0,
    "gdelt_doc_api_company_query": 16.0,
    "etnet_hk_stock_news": 16.0,
    "tdnet_jpx_disclosure": 36.0,
    "minkabu_stock_news": 18.0,
    "yahoo_finance_jp_news": 18.0,
}
# Added for every name part that the source's name has.
SOURCE_NAME_BOOST = {"路透": 6.0, "reuters": 6.0, "bloomberg": 6.0, "彭博": 6.0, "财联社": 5.0, "证券时报": 5.0, "澎湃": 4.0, "界面": 4.0, "每日经济新闻": 4.0, "yahoo finance": 3.0, "新浪财经": 4.0, "东方财富": 3.0}
# Quality by extraction status; others have 6 with content and 0 without.
STATUS_SCORE = {"success": 30.0, "skip_success": 24.0, "summary_only": 16.0, "title_only": 10.0, "not_requested": 6.0, "detail_failed": 4.0, "fetch_failed": 0.0, "empty": -6.0}
# Words of market context, and words of each event.
MARKET_KEYWORDS = ["a股", "沪深", "港股", "股市", "市场", "券商", "策略", "投资", "板块", "行业", "指数", "资金", "风险偏好", "避险", "股价", "期货", "债券", "黄金", "原油", "油价", "汇率"]
EVENT_KEYWORDS = {
    "covid19_first_wave": ["疫情", "新冠", "冠状病毒", "肺炎", "武汉", "湖北", "防疫", "抗疫", "口罩", "火神山", "雷神山", "复工", "复产", "隔离", "捐赠", "医疗物资"],
    "us_israel_iran_conflict_2025": ["以色列", "伊朗", "以伊", "中东", "地缘", "冲突", "空袭", "战争", "霍尔木兹", "原油", "石油", "油价", "黄金", "避险", "军工", "大宗商品", "风险偏好"],
    "russia_ukraine_conflict_2022": ["俄罗斯", "乌克兰", "俄乌", "俄乌冲突", "制裁", "地缘", "冲突", "战争", "能源", "原油", "油价", "天然气", "粮食", "避险", "黄金", "军工", "大宗商品", "风险偏好"],
    "israel_palestine_conflict_2023": ["以色列", "巴勒斯坦", "巴以", "哈马斯", "加沙", "中东", "地缘", "冲突", "战争", "能源", "原油", "油价", "黄金", "避险", "军工", "大宗商品", "风险偏好"],
}
# Confidence by alias type; other types go by length.
ALIAS_CONFIDENCE = {"ticker": 0.95, "legal_or_stock_name": 0.95, "manual_alias": 0.90}
# Least score of an accepted hit.
MIN_ALIGNMENT = 18.0
# Currency by market.
CURRENCY = {"CSI300": "CNY", "HSTECH": "HKD", "Nikkei225": "JPY", "SP500": "USD"}
