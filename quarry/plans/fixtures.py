"""A small code tree with neutral names, the input of the extractor and graph queries in both engines."""

from __future__ import annotations

FILES = {
    "app/code/Acme/Shop/etc/di.xml": """<config>
  <preference for="Acme\\Shop\\Api\\CartInterface" type="Acme\\Shop\\Model\\Cart"/>
  <preference type="Acme\\Shop\\Model\\ItemRepository" for="Acme\\Shop\\Api\\ItemRepositoryInterface"/>
  <type name="Acme\\Shop\\Model\\Cart">
    <plugin name="log_cart" type="Acme\\Shop\\Plugin\\LogCart" sortOrder="10"/>
    <plugin name="old_cart" type="Acme\\Shop\\Plugin\\OldCart" disabled="true"/>
    <arguments><argument name="limit" xsi:type="number">25</argument></arguments>
  </type>
  <type name="Acme\\Shop\\Api\\ItemRepositoryInterface">
    <plugin sortOrder="20" name="cache_items" type="Acme\\Shop\\Plugin\\CacheItems"/>
  </type>
  <virtualType name="Acme\\Shop\\Logger" type="Acme\\Base\\Logger">
    <arguments><argument name="file" xsi:type="string">shop.log</argument></arguments>
  </virtualType>
</config>""",
    "app/code/Acme/Shop/etc/adminhtml/di.xml": """<config><preference for="Acme\\Shop\\Api\\CartInterface" type="Acme\\Shop\\Model\\AdminCart"/></config>""",
    "app/code/Acme/Shop/etc/events.xml": """<config>
  <event name="cart_saved"><observer name="notify" instance="Acme\\Shop\\Observer\\Notify" method="send"/><observer name="count" instance="Acme\\Shop\\Observer\\Count"/></event>
  <event name="item_removed"><observer instance="Acme\\Shop\\Observer\\Count" name="count_items"/></event>
</config>""",
    "app/code/Acme/Shop/etc/webapi.xml": """<routes>
  <route url="/V1/carts/:id" method="get"><service class="Acme\\Shop\\Api\\CartInterface" method="load"/><resources><resource ref="Acme_Shop::cart"/></resources></route>
  <route method="POST" url="/V1/items"><service class="Acme\\Shop\\Api\\ItemRepositoryInterface" method="save"/><resources><resource ref="self"/><resource ref="Acme_Shop::items"/></resources></route>
</routes>""",
    "app/code/Acme/Shop/etc/adminhtml/system.xml": """<config><system><section id="shop"><group id="cart"><field id="limit" type="text"><label>Cart limit</label></field><field id="mode" type="select"><label>Mode</label><source_model>Acme\\Shop\\Model\\Mode</source_model></field></group></section></system></config>""",
    "app/code/Acme/Shop/etc/fieldset.xml": """<config><scope id="global"><fieldset id="convert_cart"><field name="total"><aspect name="to_order"/><aspect name="to_quote"/></field><field name="note"><aspect name="to_order"/></field></fieldset></scope></config>""",
    "app/code/Acme/Shop/etc/schema.graphqls": """type Query {
  cart(id: Int!): Cart @resolver(class: "Acme\\\\Shop\\\\Model\\\\Resolver\\\\Cart")
  items: [Item] @doc(description: "All items") @resolver(class: "\\\\Acme\\\\Shop\\\\Model\\\\Resolver\\\\Items")
  plain: String
}""",
    "app/code/Acme/Shop/view/frontend/layout/cart_index.xml": """<page><body><container name="cart.top"><block class="Acme\\Shop\\Block\\Cart" name="cart.list" template="a.phtml"/></container><referenceBlock name="page.title"/><block name="cart.list"/></body></page>""",
    "app/code/Acme/Shop/Model/Cart.php": """<?php
namespace Acme\\Shop\\Model;

use Acme\\Shop\\Api\\CartInterface;

class Cart extends BaseCart implements CartInterface, \\Countable
{
    public function __construct(ItemRepositoryInterface $items, \\Acme\\Base\\Logger $logger)
    {
        $this->items = $items;
    }

    public function load($id)
    {
        $row = $this->items->fetch($id);
        if ($row && $row->isOpen() || $id > 3) {
            $name = $order->getCustomer()->getName();
        }
        return $row;
    }

    protected function save()
    {
        $this->eventManager->dispatch('cart_saved', ['cart' => $this]);
        $item->setPrice(null);
        if ($quote->getAddress() !== null) {
            $c = $quote->getAddress()->getCity();
        }
        $x = $pay?->getMethod()?->getTitle();
    }
}
""",
    "app/code/Acme/Shop/Model/BaseCart.php": """<?php
namespace Acme\\Shop\\Model;

abstract class BaseCart extends Entity
{
    public function count() { return $this->getConnection()->fetchOne("SELECT count(*) FROM shop_cart JOIN shop_item USING (id) WHERE open = 1"); }
}
""",
    "app/code/Acme/Shop/Model/Entity.php": """<?php
namespace Acme\\Shop\\Model;

class Entity
{
    private static function table() { return $this->res->getTableName('shop_entity'); }
}
""",
    "app/code/Acme/Shop/Plugin/LogCart.php": """<?php
namespace Acme\\Shop\\Plugin;

class LogCart
{
    public function beforeLoad($subject, $id) { return [$id]; }
    public function afterLoad($subject, $result) { return $result; }
    public function aroundSave($subject, callable $next) { return $next(); }
    public function help() { }
}
""",
    "app/code/Acme/Shop/Setup/Install.php": """<?php
namespace Acme\\Shop\\Setup;

class Install
{
    public function run($setup)
    {
        $t = $this->triggerFactory->create()->setName('trg_cart')->setTime(Trigger::TIME_AFTER)->setEvent(Trigger::EVENT_INSERT)->setTable('shop_cart');
        $u = $this->triggerFactory->create()
            ->setName('trg_item')->setTime(Trigger::TIME_BEFORE)
            ->setEvent(Trigger::EVENT_DELETE)->setTable($itemTable)
            ->addStatement('INSERT INTO shop_log SELECT * FROM `shop_item` WHERE id = OLD.id');
        $c->createTrigger($u);
        $c->dropTrigger('trg_old');
        $c->newTable($setup->getTable('shop_new'));
        $c->newTable('shop_plain');
        $x = $setup->getTable("shop_named");
    }
}
""",
    "app/code/Acme/Shop/Observer/Count.php": """<?php
namespace Acme\\Shop\\Observer;

class Count
{
    public function execute($observer)
    {
        $this->bus->dispatch("count_done");
    }
}
""",
    "app/code/Acme/Shop/Unit/CartTest.php": """<?php
class CartTest
{
    public function testLoad() { $m = $this->createMock(Cart::class); }
    public function testSave() { }
}
""",
    "vendor/acme/module-extra/Controller/Index/View.php": """<?php
namespace Acme\\Extra\\Controller\\Index;

class View
{
    public function execute() { }
}
""",
    "vendor/acme/module-extra/view/frontend/web/js/slider.js": """define(['jquery', 'uiComponent'], function ($, Component) {
    return Component.extend({});
});
""",
    "vendor/acme/module-guard/Model/Chains.php": """<?php
namespace Acme\\Guard\\Model;

class Chains
{
    public function plain() { $a->one()->two(); $b->three($x, 1)->four(); }







    public function over()
    {
        $cart
            ->getQuote()
            ->getId();
    }







    public function safe() { $c->five()?->six(); $d->seven()->eight(); }







    public function checks()
    {
        if (!isset($e) || is_null($f)) { return; }
        $e->nine()->ten();
        $f->nine()->ten();
        $g->nine()->ten();
    }







    public function compared($h)
    {
        if ($h === null) { return; }
        $h->nine()->ten();
        if ($i instanceof Item) { $i->nine()->ten(); }
    }







    public function negated($j)
    {
        $ok = all(!$j, 1);
        $j->nine()->ten();
    }







    public function chosen($k)
    {
        $k->nine()->ten();
        $y = $z ?: 1;
    }







    public function merged($l)
    {
        $l->nine()->ten();
        $y = $z ?? 1;
    }







    public function nulls($item)
    {
        $item->setPrice(null);
        $item->setData('price', null);
        $item->setMany(
            null,
            1
        );
        $item->setPrice(nullable());
        $item->settle(null);
    }
}
""",
    "app/code/Acme/Shop/Model/Sql.php": """<?php
namespace Acme\\Shop\\Model;

class Sql
{
    const PATH = 'shop/cart/limit';

    public function run()
    {
        $e = new \\Zend_Db_Expr('SELECT id FROM `Shop_Cart` JOIN shop_item ON 1 LEFT JOIN related ON 1');
        $this->db->query("UPDATE shop_rate SET x = 1 WHERE y IN (SELECT z FROM main_table)");
        $a = $this->res->getTable('shop_order');
        $b = $this->res->getConnection()->select()->from($this->res->getTableName("Shop_Order_Item"));
        $c = "SELECT * FROM shop_unseen";
        return $this->config->getValue(self::PATH);
    }
}
""",
    "app/code/Acme/Shop/Model/Many.php": """<?php
namespace Acme\\Shop\\Model;

use Acme\\Other\\Base as OtherBase;
use Acme\\Shop\\Api\\CartInterface;
use Acme\\Tools;

final class Many extends OtherBase implements
    CartInterface,
    \\Countable
{
    private ?Tools $tools;
    protected static $count = 0;
    public readonly int $id;

    public static function make(int $id, ?Tools $tools = null, string ...$names): self { return new self(); }

    abstract protected function later(&$row);
}

readonly class Pair extends Tools\\Box {}

abstract class Near extends Base {}

enum Suit: string implements HasLabel { case A = 'a'; }

trait Counts {}

interface Both extends CartInterface, \\Countable {}
""",
    "app/code/Acme/Shop/Model/Base.php": """<?php
namespace Acme\\Shop\\Model;

class Base extends \\Acme\\Other\\Base
{
    protected function shared() { return $this->helper->load(1); }
}
""",
    "app/code/Acme/Other/Base.php": """<?php
namespace Acme\\Other;

abstract class Base
{
    public function __construct(
        \\Acme\\Shop\\Api\\CartInterface $helper
    ) {
        $this->helper = $helper;
    }

    public function top() { return $this->missing(); }
}
""",
    "app/code/Acme/Shop/Model/Leaf.php": """<?php
namespace Acme\\Shop\\Model;

class Leaf extends Near
{
    public function start()
    {
        $this->shared();
        $this->top();
        return $this->helper->load(2);
    }
}
""",
    "app/code/Acme/Shop/etc/frontend/di.xml": """<config>
  <type name="Acme\\Shop\\Model\\Pool">
    <arguments>
      <argument xsi:type="string" name="label"> Pool </argument>
      <argument name="modifiers" xsi:type="array">
        <item name="first" xsi:type="object">Acme\\Shop\\First</item>
        <item xsi:type="string" sortOrder="2" name="second">two</item>
      </argument>
    </arguments>
  </type>
</config>""",
    "app/code/Acme/Other/etc/fieldset.xml": """<config><fieldset id="flat"><field name="a"><aspect name="to_b"/></field></fieldset><scope id="admin"><fieldset id="inner"><field name="c"><aspect name="to_d"/></field></fieldset></scope></config>""",
    "app/code/Acme/Shop/Unit/ManyTest.php": """<?php
/** @covers \\Acme\\Shop\\Model\\Many::make */
class ManyTest
{
    public function testMake() { $b = $this->getMockBuilder(Many::class); }
}
""",
    "app/code/Acme/Shop/view/base/web/js/module.js": """import $ from 'jquery';
import { x } from "Acme_Shop/js/x";
export class Basket {}
export default function total(a) { return a; }
const y = 1;
""",
    "app/code/Acme/Shop/view/base/web/js/node.js": """const ko = require('ko');
function first() {}
exports.second = first;
module.exports = { first };
""",
    "app/code/Acme/Shop/view/base/web/js/once.js": """(function($) { $.widget('acme.once', {}); })(jQuery);
""",
    "app/code/Acme/Shop/view/base/web/js/mixin.js": """var config = { config: { 'mixins': { 'Acme_Shop/js/x': { 'Acme_Shop/js/y': true } } } };
""",
    "app/code/Acme/Shop/Observer/Notify.php": """<?php
namespace Acme\\Shop\\Observer;

use Acme\\Event\\ObserverInterface;

class Notify implements ObserverInterface
{
    public function send($observer) { return 1; }
}
""",
    "app/code/Acme/Shop/Helper/Text.php": """<?php
namespace Acme\\Shop\\Helper;

class Text extends AbstractHelper {}
""",
    "app/code/Acme/Shop/Setup/Patch/Fill.php": """<?php
namespace Acme\\Shop\\Setup\\Patch;

class Fill implements DataPatchInterface {}
""",
    "app/code/Acme/Ship/Model/Carrier/Flat.php": """<?php
namespace Acme\\Ship\\Model\\Carrier;

class Flat extends AbstractCarrier
{
    public function collectRates($request) { return []; }
}
""",
    "app/code/Acme/Ship/Plugin/Rates.php": """<?php
namespace Acme\\Ship\\Plugin;

class Rates
{
    public function afterCollectRates($subject, $result) { return $result; }
}
""",
    "app/code/Acme/Ship/Model/RateModifier.php": """<?php
namespace Acme\\Ship\\Model;

class RateModifier {}
""",
    "app/code/Acme/Ship/Model/Total/Shipping.php": """<?php
namespace Acme\\Ship\\Model\\Total;

class Shipping
{
    public function collect($quote) { return $quote; }
}
""",
    "app/code/Acme/Ship/etc/di.xml": """<config><type name="Acme\\Base\\AbstractCarrierInterface"><plugin name="rates" type="Acme\\Ship\\Plugin\\Rates"/></type></config>""",
    "app/code/Acme/Ship/etc/fieldset.xml": """<config><scope id="global"><fieldset id="sales_convert_quote"><field name="weight"><aspect name="to_order"/></field></fieldset></scope></config>""",
    "app/code/Acme/Ship/etc/db_schema.xml": """<schema><table name="shop_item" resource="default"><column name="id"/></table></schema>""",
    "lib/internal/Acme/Framework/Base.php": """<?php
namespace Acme\\Framework;

interface Base
{
}
""",
}
CALLS = [("Cart::save", "Cart::load"), ("Cart::load", "ItemRepository::fetch"), ("ItemRepository::fetch", "Connection::query"), ("Cart::save", "EventManager::dispatch"), ("Connection::query", "Connection::open"), ("Cart::load", "Cart::save")]
#: Rows of an index, for every rule of the keyword bonus: id, path, search_text, class_name, component_type, flags.
INDEX = [
    (1, "a/Helper/Data.php", "text helper", "Data", "helper", False, False, False, False),
    (2, "a/etc/di.xml", "wires", None, "di_config", False, False, False, False),
    (3, "a/etc/db_schema.xml", "tables", None, "db_schema", False, False, False, False),
    (4, "a/Plugin/Log.php", "log", "Log", "plugin", True, False, False, False),
    (5, "a/Model/ItemRepository.php", "items", "ItemRepository", "model", False, False, False, False),
    (6, "a/Model/Items.php", "items", "Items", "repository", False, True, False, False),
    (7, "a/Setup/Install.php", "install", "Install", "setup", False, False, False, False),
    (8, "a/Observer/Count.php", "count", "Count", "observer", False, False, True, False),
    (9, "a/Resolver/Cart.php", "cart", "Cart", "model", False, False, False, False),
    (10, "a/Model/Carts.php", "cart", "Carts", "graphql_resolver", False, False, False, True),
    (11, "a/etc/schema.graphqls", "schema", None, "graphql_schema", False, False, False, False),
    (12, "a/graph-ql/x.php", "x", "X", "other", False, False, False, False),
    (13, "lib/Framework/Plugin/AbstractPlugin.php", "plugin base", "AbstractPlugin", "plugin", False, False, False, False),
    (14, "lib/framework/PluginInterface.php", "plugin", "PluginInterface", "other", False, False, False, False),
    (15, "a/plugin/plugin/Plugin.php", "plugin observer setup helper", "PluginObserverSetup", "plugin", True, True, True, True),
]
BONUS_QUERIES = ["helper", "di.xml for items", "db_schema tables", "plugin", "repository items", "setup of it", "observer", "resolver cart", "graphql schema", "plugin plugin observer setup helper"]
ERRORS = [
    (1, "Cannot instantiate interface Acme\\Shop\\Api\\CartInterface in vendor/acme/a.php:12"),
    (2, "Class Acme\\Shop\\Model\\Gone does not exist at app/b.php(33)"),
    (3, "Area code is not set"),
    (4, "SQLSTATE[42S02]: Base table or view not found: 1146 Table 'db.shop_cart' doesn't exist"),
    (5, "Plugin class Acme\\P doesn't exist"),
    (6, "Something else went wrong in x/y.phtml:7 and c.php(9)"),
    (7, "Circular dependency: A\\B, C\\D"),
]
CONFIG = [("live", "default", "shop/cart/limit", "25"), ("live", "stores", "shop/cart/limit", "30"), ("stage", "default", "shop/cart/limit", "5"), ("live", "default", "web/url", "https://x")]
RESULTS = [
    # qid, id, path, type, component_type, module, score, is_plugin, is_controller
    (1, 1, "vendor/acme-tools_module-cart/Plugin/A.php", "php", "plugin", "acme-tools_module-cart", 0.40, True, False),
    (1, 2, "app/code/Acme/Shop/etc/di.xml", "xml", "di_config", "Acme_Shop", 0.38, False, False),
    (1, 3, "app/code/Other/Cart/Controller/View.php", "php", "controller", "Other_Cart", 0.30, False, True),
    (1, 2, "app/code/Acme/Shop/etc/di.xml", "xml", "di_config", "Acme_Shop", 0.55, False, False),
    (2, 4, "vendor/acme/module-catalog/Model/Item.php", "php", "model", "acme_module-catalog", 0.60, False, False),
    (2, 5, "lib/internal/Acme/Framework/Base.php", "php", "other", None, 0.20, False, False),
    (3, 6, "app/code/Other/Cart/Plugin/B.php", "php", "plugin", "Other_Cart", 0.10, True, False),
]
QUERIES = [(1, "plugin for checkout order"), (2, "the Order ORDER plugin"), (3, "a bb ccc"), (4, "nothing here")]
NAMES = [(1, "CartItemRepository"), (2, "loadById"), (3, "plain"), (4, "XMLReader")]
ENTRIES = [(1, "/V1/carts"), (2, "cart_saved_after"), (3, "cartItems"), (4, "shop/cart/view"), (5, "plain")]


GATE_CALLS = [
    (1, 1, "2024-01-01 00:00:00", "search", 5), (1, 2, "2024-01-01 00:00:29", "find_plugin", None), (1, 3, "2024-01-01 00:00:30", "find_class", None), (1, 4, "2024-01-01 00:00:59", "search", 6),
    (1, 5, "2024-01-01 00:01:59", "search", 7), (1, 6, "2024-01-01 00:02:10", "search", 7), (1, 7, "2024-01-01 00:02:20", "trace_flow", None), (1, 8, "2024-01-01 00:02:21", "find_config", None), (1, 9, "2024-01-01 00:02:22", "grep", None),
    (2, 10, "2024-01-01 00:00:00", "find_observer", None), (2, 11, "2024-01-01 00:00:01", "search", None), (2, 12, "2024-01-01 00:00:02", "find_observer", None), (2, 13, "2024-01-01 00:00:03", "find_controller", None), (2, 14, "2024-01-01 00:00:04", "find_block", None),
]
CONDITIONS = [
    {"types": ["plugin", "Controller"]},
    {"patterns": ["plugin", "controller"], "module": "Acme_Shop"},
    {"classes": ["Item", "A"], "content": ["HAS", "item"]},
    {"methods": ["none"], "file_types": ["xml"]},
    {"module": "Other_Cart"},
    {},
]
CASES = [(1, ["plugin", "cart"], ["test"], 0.3), (2, ["plugin", "cart"], ["test"], 0.3), (3, ["plugin", "cart", "tax"], [], 0.1), (4, ["plugin", "tax"], [], 0.9), (5, ["plugin", "tax"], ["x"], 0.0), (6, ["tax", "rate"], [], 0.0)]
CASE_RESULTS = [
    (1, 1, "A Plugin for it", 0.5), (1, 2, "test at six", 0.4), (1, 11, "cart too late", 0.1), (2, 1, "a plugin", 0.5), (2, 6, "a test, but too late", 0.3), (3, 1, "nothing", 0.5), (4, 1, "tax plugin", 0.5), (5, 1, "no match", 0.5), (5, 2, "x", 0.4), (6, 1, "no", 0.1),
]
DIFFS = [("a/etc/di.xml", "--- a\n+++ b\n+x\n+y\n-z"), ("a/Model/X.php", "+1\n" * 150 + "-2\n" * 100), ("a/Plugin/Y.php", ""), ("a/Model/Z.php", " same\n-gone")]


def literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    return str(value) if isinstance(value, (int, float)) else "'" + value.replace("'", "''") + "'"


def values(rows: list[tuple], names: str) -> str:
    """A VALUES clause for DuckDB: t(names)."""
    return "(VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) + f") t({names})"


FILES_SQL = values(list(FILES.items()), "path, content")
