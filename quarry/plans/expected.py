"""Results of queries over the inline code tree: name -> (columns, rows). The rows were taken from the engine's output and read
against the rules; they are no second implementation."""

from __future__ import annotations

EXPECTED: dict[str, tuple[str, list[tuple]]] = {
    "method_chains": (
        "path VARCHAR, line BIGINT, receiver VARCHAR, first_method VARCHAR, second_method VARCHAR, has_null_guard BOOLEAN",
        [
            ('app/code/Acme/Shop/Model/BaseCart.php', 6, 'this', 'getConnection', 'fetchOne', False),
            ('app/code/Acme/Shop/Model/Cart.php', 17, 'order', 'getCustomer', 'getName', False),
            ('app/code/Acme/Shop/Model/Cart.php', 27, 'quote', 'getAddress', 'getCity', False),
            ('vendor/acme/module-guard/Model/Chains.php', 16, 'cart', 'getQuote', 'getId', False),
            ('vendor/acme/module-guard/Model/Chains.php', 27, 'd', 'seven', 'eight', True),
            ('vendor/acme/module-guard/Model/Chains.php', 38, 'e', 'nine', 'ten', True),
            ('vendor/acme/module-guard/Model/Chains.php', 39, 'f', 'nine', 'ten', True),
            ('vendor/acme/module-guard/Model/Chains.php', 40, 'g', 'nine', 'ten', False),
            ('vendor/acme/module-guard/Model/Chains.php', 52, 'h', 'nine', 'ten', True),
            ('vendor/acme/module-guard/Model/Chains.php', 53, 'i', 'nine', 'ten', False),
            ('vendor/acme/module-guard/Model/Chains.php', 6, 'a', 'one', 'two', False),
            ('vendor/acme/module-guard/Model/Chains.php', 6, 'b', 'three', 'four', False),
            ('vendor/acme/module-guard/Model/Chains.php', 65, 'j', 'nine', 'ten', True),
            ('vendor/acme/module-guard/Model/Chains.php', 76, 'k', 'nine', 'ten', True),
            ('vendor/acme/module-guard/Model/Chains.php', 88, 'l', 'nine', 'ten', True),
        ],
    ),
    "null_risks": (
        "first_method VARCHAR, second_method VARCHAR, n_sites BIGINT, sites VARCHAR",
        [
            ('getAddress', 'getCity', 1, 'app/code/Acme/Shop/Model/Cart.php:27'),
            ('getConnection', 'fetchOne', 1, 'app/code/Acme/Shop/Model/BaseCart.php:6'),
            ('getCustomer', 'getName', 1, 'app/code/Acme/Shop/Model/Cart.php:17'),
            ('getQuote', 'getId', 1, 'vendor/acme/module-guard/Model/Chains.php:16'),
            ('nine', 'ten', 2, 'vendor/acme/module-guard/Model/Chains.php:40,vendor/acme/module-guard/Model/Chains.php:53'),
            ('one', 'two', 1, 'vendor/acme/module-guard/Model/Chains.php:6'),
            ('three', 'four', 1, 'vendor/acme/module-guard/Model/Chains.php:6'),
        ],
    ),
    "set_null_calls": (
        "path VARCHAR, line BIGINT, setter VARCHAR",
        [
            ('app/code/Acme/Shop/Model/Cart.php', 25, 'setPrice'),
            ('vendor/acme/module-guard/Model/Chains.php', 100, 'setPrice'),
            ('vendor/acme/module-guard/Model/Chains.php', 101, 'setData'),
            ('vendor/acme/module-guard/Model/Chains.php', 102, 'setMany'),
        ],
    ),
    "unchecked_chains": (
        "path VARCHAR, line BIGINT, property VARCHAR, callee VARCHAR",
        [
            ('app/code/Acme/Shop/Model/Base.php', 6, 'helper', 'load'),
            ('app/code/Acme/Shop/Model/Cart.php', 15, 'items', 'fetch'),
            ('app/code/Acme/Shop/Model/Cart.php', 24, 'eventManager', 'dispatch'),
            ('app/code/Acme/Shop/Model/Entity.php', 6, 'res', 'getTableName'),
            ('app/code/Acme/Shop/Model/Leaf.php', 10, 'helper', 'load'),
            ('app/code/Acme/Shop/Model/Sql.php', 11, 'db', 'query'),
            ('app/code/Acme/Shop/Model/Sql.php', 12, 'res', 'getTable'),
            ('app/code/Acme/Shop/Model/Sql.php', 13, 'res', 'getConnection'),
            ('app/code/Acme/Shop/Model/Sql.php', 13, 'res', 'getTableName'),
            ('app/code/Acme/Shop/Model/Sql.php', 15, 'config', 'getValue'),
            ('app/code/Acme/Shop/Observer/Count.php', 8, 'bus', 'dispatch'),
            ('app/code/Acme/Shop/Setup/Install.php', 8, 'triggerFactory', 'create'),
            ('app/code/Acme/Shop/Setup/Install.php', 9, 'triggerFactory', 'create'),
        ],
    ),
    "method_body": (
        "path VARCHAR, method VARCHAR, body VARCHAR, cut VARCHAR, snippet VARCHAR",
        [
            ('app/code/Acme/Shop/Model/BaseCart.php', 'later', None, None, None),
            ('app/code/Acme/Shop/Model/BaseCart.php', 'load', None, None, None),
            ('app/code/Acme/Shop/Model/BaseCart.php', 'make', None, None, None),
            ('app/code/Acme/Shop/Model/BaseCart.php', 'none', None, None, None),
            ('app/code/Acme/Shop/Model/BaseCart.php', 'save', None, None, None),
            ('app/code/Acme/Shop/Model/Cart.php', 'later', None, None, None),
            ('app/code/Acme/Shop/Model/Cart.php', 'load', '    public function load($id)\n    {\n        $row = $this->items->fetch($id);\n        if ($row && $row->isOpen() || $id > 3) {\n            $name = $order->getCustomer()->getName();\n        }\n        return $row;\n    }', '    public function load($id)\n    {\n        $row = $this->items->fetch($id);', '    public function load($id)\n    {'),
            ('app/code/Acme/Shop/Model/Cart.php', 'make', None, None, None),
            ('app/code/Acme/Shop/Model/Cart.php', 'none', None, None, None),
            ('app/code/Acme/Shop/Model/Cart.php', 'save', "    protected function save()\n    {\n        $this->eventManager->dispatch('cart_saved', ['cart' => $this]);\n        $item->setPrice(null);\n        if ($quote->getAddress() !== null) {\n            $c = $quote->getAddress()->getCity();\n        }\n        $x = $pay?->getMethod()?->getTitle();\n    }", "    protected function save()\n    {\n        $this->eventManager->dispatch('cart_saved', ['cart' => $this]);", '    protected function save()\n    {'),
            ('app/code/Acme/Shop/Model/Many.php', 'later', '    abstract protected function later(&$row);\n}\n\nreadonly class Pair extends Tools\\Box {}', '    abstract protected function later(&$row);\n}\n', '    abstract protected function later(&$row);\n}'),
            ('app/code/Acme/Shop/Model/Many.php', 'load', None, None, None),
            ('app/code/Acme/Shop/Model/Many.php', 'make', '    public static function make(int $id, ?Tools $tools = null, string ...$names): self { return new self(); }', '    public static function make(int $id, ?Tools $tools = null, string ...$names): self { return new self(); }', '    public static function make(int $id, ?Tools $tools = null, string ...$names): self { return new self(); }\n'),
            ('app/code/Acme/Shop/Model/Many.php', 'none', None, None, None),
            ('app/code/Acme/Shop/Model/Many.php', 'save', None, None, None),
            ('app/code/Acme/Shop/Plugin/LogCart.php', 'later', None, None, None),
            ('app/code/Acme/Shop/Plugin/LogCart.php', 'load', None, None, None),
            ('app/code/Acme/Shop/Plugin/LogCart.php', 'make', None, None, None),
            ('app/code/Acme/Shop/Plugin/LogCart.php', 'none', None, None, None),
            ('app/code/Acme/Shop/Plugin/LogCart.php', 'save', None, None, None),
        ],
    ),
    "php_classes": (
        "fqcn VARCHAR, kind VARCHAR, is_abstract BOOLEAN, parent VARCHAR, interfaces VARCHAR, path VARCHAR",
        [
            ('Acme\\Extra\\Controller\\Index\\View', 'class', False, None, None, 'vendor/acme/module-extra/Controller/Index/View.php'),
            ('Acme\\Framework\\Base', 'interface', False, None, None, 'lib/internal/Acme/Framework/Base.php'),
            ('Acme\\Guard\\Model\\Chains', 'class', False, None, None, 'vendor/acme/module-guard/Model/Chains.php'),
            ('Acme\\Other\\Base', 'class', True, None, None, 'app/code/Acme/Other/Base.php'),
            ('Acme\\Ship\\Model\\Carrier\\Flat', 'class', False, 'AbstractCarrier', None, 'app/code/Acme/Ship/Model/Carrier/Flat.php'),
            ('Acme\\Ship\\Model\\RateModifier', 'class', False, None, None, 'app/code/Acme/Ship/Model/RateModifier.php'),
            ('Acme\\Ship\\Model\\Total\\Shipping', 'class', False, None, None, 'app/code/Acme/Ship/Model/Total/Shipping.php'),
            ('Acme\\Ship\\Plugin\\Rates', 'class', False, None, None, 'app/code/Acme/Ship/Plugin/Rates.php'),
            ('Acme\\Shop\\Helper\\Text', 'class', False, 'AbstractHelper', None, 'app/code/Acme/Shop/Helper/Text.php'),
            ('Acme\\Shop\\Model\\Base', 'class', False, '\\Acme\\Other\\Base', None, 'app/code/Acme/Shop/Model/Base.php'),
            ('Acme\\Shop\\Model\\BaseCart', 'class', True, 'Entity', None, 'app/code/Acme/Shop/Model/BaseCart.php'),
            ('Acme\\Shop\\Model\\Both', 'interface', False, 'CartInterface,\\Countable', None, 'app/code/Acme/Shop/Model/Many.php'),
            ('Acme\\Shop\\Model\\Cart', 'class', False, 'BaseCart', 'CartInterface, \\Countable', 'app/code/Acme/Shop/Model/Cart.php'),
            ('Acme\\Shop\\Model\\Counts', 'trait', False, None, None, 'app/code/Acme/Shop/Model/Many.php'),
            ('Acme\\Shop\\Model\\Entity', 'class', False, None, None, 'app/code/Acme/Shop/Model/Entity.php'),
            ('Acme\\Shop\\Model\\Leaf', 'class', False, 'Near', None, 'app/code/Acme/Shop/Model/Leaf.php'),
            ('Acme\\Shop\\Model\\Many', 'class', False, 'OtherBase', 'CartInterface, \\Countable', 'app/code/Acme/Shop/Model/Many.php'),
            ('Acme\\Shop\\Model\\Near', 'class', True, 'Base', None, 'app/code/Acme/Shop/Model/Many.php'),
            ('Acme\\Shop\\Model\\Pair', 'class', False, 'Tools\\Box', None, 'app/code/Acme/Shop/Model/Many.php'),
            ('Acme\\Shop\\Model\\Sql', 'class', False, None, None, 'app/code/Acme/Shop/Model/Sql.php'),
            ('Acme\\Shop\\Model\\Suit', 'enum', False, None, 'HasLabel', 'app/code/Acme/Shop/Model/Many.php'),
            ('Acme\\Shop\\Observer\\Count', 'class', False, None, None, 'app/code/Acme/Shop/Observer/Count.php'),
            ('Acme\\Shop\\Observer\\Notify', 'class', False, None, 'ObserverInterface', 'app/code/Acme/Shop/Observer/Notify.php'),
            ('Acme\\Shop\\Plugin\\LogCart', 'class', False, None, None, 'app/code/Acme/Shop/Plugin/LogCart.php'),
            ('Acme\\Shop\\Setup\\Install', 'class', False, None, None, 'app/code/Acme/Shop/Setup/Install.php'),
            ('Acme\\Shop\\Setup\\Patch\\Fill', 'class', False, None, 'DataPatchInterface', 'app/code/Acme/Shop/Setup/Patch/Fill.php'),
            ('CartTest', 'class', False, None, None, 'app/code/Acme/Shop/Unit/CartTest.php'),
            ('ManyTest', 'class', False, None, None, 'app/code/Acme/Shop/Unit/ManyTest.php'),
        ],
    ),
    "php_imports": (
        "path VARCHAR, fqcn VARCHAR, alias VARCHAR",
        [
            ('app/code/Acme/Shop/Model/Cart.php', 'Acme\\Shop\\Api\\CartInterface', 'CartInterface'),
            ('app/code/Acme/Shop/Model/Many.php', 'Acme\\Other\\Base', 'OtherBase'),
            ('app/code/Acme/Shop/Model/Many.php', 'Acme\\Shop\\Api\\CartInterface', 'CartInterface'),
            ('app/code/Acme/Shop/Model/Many.php', 'Acme\\Tools', 'Tools'),
            ('app/code/Acme/Shop/Observer/Notify.php', 'Acme\\Event\\ObserverInterface', 'ObserverInterface'),
        ],
    ),
    "php_parents": (
        "fqcn VARCHAR, parent VARCHAR, path VARCHAR",
        [
            ('Acme\\Ship\\Model\\Carrier\\Flat', 'Acme\\Ship\\Model\\Carrier\\AbstractCarrier', 'app/code/Acme/Ship/Model/Carrier/Flat.php'),
            ('Acme\\Shop\\Helper\\Text', 'Acme\\Shop\\Helper\\AbstractHelper', 'app/code/Acme/Shop/Helper/Text.php'),
            ('Acme\\Shop\\Model\\Base', 'Acme\\Other\\Base', 'app/code/Acme/Shop/Model/Base.php'),
            ('Acme\\Shop\\Model\\BaseCart', 'Acme\\Shop\\Model\\Entity', 'app/code/Acme/Shop/Model/BaseCart.php'),
            ('Acme\\Shop\\Model\\Both', 'Acme\\Shop\\Api\\CartInterface', 'app/code/Acme/Shop/Model/Many.php'),
            ('Acme\\Shop\\Model\\Both', 'Countable', 'app/code/Acme/Shop/Model/Many.php'),
            ('Acme\\Shop\\Model\\Cart', 'Acme\\Shop\\Model\\BaseCart', 'app/code/Acme/Shop/Model/Cart.php'),
            ('Acme\\Shop\\Model\\Leaf', 'Acme\\Shop\\Model\\Near', 'app/code/Acme/Shop/Model/Leaf.php'),
            ('Acme\\Shop\\Model\\Many', 'Acme\\Other\\Base', 'app/code/Acme/Shop/Model/Many.php'),
            ('Acme\\Shop\\Model\\Near', 'Acme\\Shop\\Model\\Base', 'app/code/Acme/Shop/Model/Many.php'),
            ('Acme\\Shop\\Model\\Pair', 'Acme\\Tools\\Box', 'app/code/Acme/Shop/Model/Many.php'),
        ],
    ),
    "php_methods": (
        "path VARCHAR, visibility VARCHAR, method VARCHAR, is_static BOOLEAN, is_abstract BOOLEAN, return_type VARCHAR, params VARCHAR",
        [
            ('app/code/Acme/Other/Base.php', 'public', '__construct', False, False, None, '\\Acme\\Shop\\Api\\CartInterface $helper'),
            ('app/code/Acme/Other/Base.php', 'public', 'top', False, False, None, ''),
            ('app/code/Acme/Ship/Model/Carrier/Flat.php', 'public', 'collectRates', False, False, None, '$request'),
            ('app/code/Acme/Ship/Model/Total/Shipping.php', 'public', 'collect', False, False, None, '$quote'),
            ('app/code/Acme/Ship/Plugin/Rates.php', 'public', 'afterCollectRates', False, False, None, '$subject, $result'),
            ('app/code/Acme/Shop/Model/Base.php', 'protected', 'shared', False, False, None, ''),
            ('app/code/Acme/Shop/Model/BaseCart.php', 'public', 'count', False, False, None, ''),
            ('app/code/Acme/Shop/Model/Cart.php', 'protected', 'save', False, False, None, ''),
            ('app/code/Acme/Shop/Model/Cart.php', 'public', '__construct', False, False, None, 'ItemRepositoryInterface $items, \\Acme\\Base\\Logger $logger'),
            ('app/code/Acme/Shop/Model/Cart.php', 'public', 'load', False, False, None, '$id'),
            ('app/code/Acme/Shop/Model/Entity.php', 'private', 'table', True, False, None, ''),
            ('app/code/Acme/Shop/Model/Leaf.php', 'public', 'start', False, False, None, ''),
            ('app/code/Acme/Shop/Model/Many.php', 'protected', 'later', False, True, None, '&$row'),
            ('app/code/Acme/Shop/Model/Many.php', 'public', 'make', True, False, 'self', 'int $id, ?Tools $tools = null, string ...$names'),
            ('app/code/Acme/Shop/Model/Sql.php', 'public', 'run', False, False, None, ''),
            ('app/code/Acme/Shop/Observer/Count.php', 'public', 'execute', False, False, None, '$observer'),
            ('app/code/Acme/Shop/Observer/Notify.php', 'public', 'send', False, False, None, '$observer'),
            ('app/code/Acme/Shop/Plugin/LogCart.php', 'public', 'afterLoad', False, False, None, '$subject, $result'),
            ('app/code/Acme/Shop/Plugin/LogCart.php', 'public', 'aroundSave', False, False, None, '$subject, callable $next'),
            ('app/code/Acme/Shop/Plugin/LogCart.php', 'public', 'beforeLoad', False, False, None, '$subject, $id'),
            ('app/code/Acme/Shop/Plugin/LogCart.php', 'public', 'help', False, False, None, ''),
            ('app/code/Acme/Shop/Setup/Install.php', 'public', 'run', False, False, None, '$setup'),
            ('app/code/Acme/Shop/Unit/CartTest.php', 'public', 'testLoad', False, False, None, ''),
            ('app/code/Acme/Shop/Unit/CartTest.php', 'public', 'testSave', False, False, None, ''),
            ('app/code/Acme/Shop/Unit/ManyTest.php', 'public', 'testMake', False, False, None, ''),
            ('vendor/acme/module-extra/Controller/Index/View.php', 'public', 'execute', False, False, None, ''),
            ('vendor/acme/module-guard/Model/Chains.php', 'public', 'checks', False, False, None, ''),
            ('vendor/acme/module-guard/Model/Chains.php', 'public', 'chosen', False, False, None, '$k'),
            ('vendor/acme/module-guard/Model/Chains.php', 'public', 'compared', False, False, None, '$h'),
            ('vendor/acme/module-guard/Model/Chains.php', 'public', 'merged', False, False, None, '$l'),
            ('vendor/acme/module-guard/Model/Chains.php', 'public', 'negated', False, False, None, '$j'),
            ('vendor/acme/module-guard/Model/Chains.php', 'public', 'nulls', False, False, None, '$item'),
            ('vendor/acme/module-guard/Model/Chains.php', 'public', 'over', False, False, None, ''),
            ('vendor/acme/module-guard/Model/Chains.php', 'public', 'plain', False, False, None, ''),
            ('vendor/acme/module-guard/Model/Chains.php', 'public', 'safe', False, False, None, ''),
        ],
    ),
    "php_params": (
        "path VARCHAR, method VARCHAR, position BIGINT, type_hint VARCHAR, variable VARCHAR, is_optional BOOLEAN",
        [
            ('app/code/Acme/Other/Base.php', '__construct', 1, '\\Acme\\Shop\\Api\\CartInterface', 'helper', False),
            ('app/code/Acme/Ship/Model/Carrier/Flat.php', 'collectRates', 1, None, 'request', False),
            ('app/code/Acme/Ship/Model/Total/Shipping.php', 'collect', 1, None, 'quote', False),
            ('app/code/Acme/Ship/Plugin/Rates.php', 'afterCollectRates', 1, None, 'subject', False),
            ('app/code/Acme/Ship/Plugin/Rates.php', 'afterCollectRates', 2, None, 'result', False),
            ('app/code/Acme/Shop/Model/Cart.php', '__construct', 1, 'ItemRepositoryInterface', 'items', False),
            ('app/code/Acme/Shop/Model/Cart.php', '__construct', 2, '\\Acme\\Base\\Logger', 'logger', False),
            ('app/code/Acme/Shop/Model/Cart.php', 'load', 1, None, 'id', False),
            ('app/code/Acme/Shop/Model/Many.php', 'later', 1, None, 'row', False),
            ('app/code/Acme/Shop/Model/Many.php', 'make', 1, 'int', 'id', False),
            ('app/code/Acme/Shop/Model/Many.php', 'make', 2, '?Tools', 'tools', True),
            ('app/code/Acme/Shop/Model/Many.php', 'make', 3, 'string', 'names', False),
            ('app/code/Acme/Shop/Observer/Count.php', 'execute', 1, None, 'observer', False),
            ('app/code/Acme/Shop/Observer/Notify.php', 'send', 1, None, 'observer', False),
            ('app/code/Acme/Shop/Plugin/LogCart.php', 'afterLoad', 1, None, 'subject', False),
            ('app/code/Acme/Shop/Plugin/LogCart.php', 'afterLoad', 2, None, 'result', False),
            ('app/code/Acme/Shop/Plugin/LogCart.php', 'aroundSave', 1, None, 'subject', False),
            ('app/code/Acme/Shop/Plugin/LogCart.php', 'aroundSave', 2, 'callable', 'next', False),
            ('app/code/Acme/Shop/Plugin/LogCart.php', 'beforeLoad', 1, None, 'subject', False),
            ('app/code/Acme/Shop/Plugin/LogCart.php', 'beforeLoad', 2, None, 'id', False),
            ('app/code/Acme/Shop/Setup/Install.php', 'run', 1, None, 'setup', False),
            ('vendor/acme/module-guard/Model/Chains.php', 'chosen', 1, None, 'k', False),
            ('vendor/acme/module-guard/Model/Chains.php', 'compared', 1, None, 'h', False),
            ('vendor/acme/module-guard/Model/Chains.php', 'merged', 1, None, 'l', False),
            ('vendor/acme/module-guard/Model/Chains.php', 'negated', 1, None, 'j', False),
            ('vendor/acme/module-guard/Model/Chains.php', 'nulls', 1, None, 'item', False),
        ],
    ),
    "php_properties": (
        "path VARCHAR, visibility VARCHAR, is_static BOOLEAN, type_hint VARCHAR, property VARCHAR",
        [
            ('app/code/Acme/Shop/Model/Many.php', 'private', False, '?Tools', 'tools'),
            ('app/code/Acme/Shop/Model/Many.php', 'protected', True, None, 'count'),
            ('app/code/Acme/Shop/Model/Many.php', 'public', False, 'int', 'id'),
        ],
    ),
    "class_roles": (
        "path VARCHAR, fqcn VARCHAR, is_controller BOOLEAN, is_repository BOOLEAN, is_plugin BOOLEAN, is_observer BOOLEAN, is_model BOOLEAN, is_block BOOLEAN, is_helper BOOLEAN, is_setup BOOLEAN, is_resolver BOOLEAN, is_api_interface BOOLEAN",
        [
            ('app/code/Acme/Other/Base.php', 'Acme\\Other\\Base', False, False, False, False, False, False, False, False, False, False),
            ('app/code/Acme/Ship/Model/Carrier/Flat.php', 'Acme\\Ship\\Model\\Carrier\\Flat', False, False, False, False, False, False, False, False, False, False),
            ('app/code/Acme/Ship/Model/RateModifier.php', 'Acme\\Ship\\Model\\RateModifier', False, False, False, False, False, False, False, False, False, False),
            ('app/code/Acme/Ship/Model/Total/Shipping.php', 'Acme\\Ship\\Model\\Total\\Shipping', False, False, False, False, False, False, False, False, False, False),
            ('app/code/Acme/Ship/Plugin/Rates.php', 'Acme\\Ship\\Plugin\\Rates', False, False, True, False, False, False, False, False, False, False),
            ('app/code/Acme/Shop/Helper/Text.php', 'Acme\\Shop\\Helper\\Text', False, False, False, False, False, False, True, False, False, False),
            ('app/code/Acme/Shop/Model/Base.php', 'Acme\\Shop\\Model\\Base', False, False, False, False, False, False, False, False, False, False),
            ('app/code/Acme/Shop/Model/BaseCart.php', 'Acme\\Shop\\Model\\BaseCart', False, False, False, False, False, False, False, False, False, False),
            ('app/code/Acme/Shop/Model/Cart.php', 'Acme\\Shop\\Model\\Cart', False, False, False, False, False, False, False, False, False, False),
            ('app/code/Acme/Shop/Model/Entity.php', 'Acme\\Shop\\Model\\Entity', False, False, False, False, False, False, False, False, False, False),
            ('app/code/Acme/Shop/Model/Leaf.php', 'Acme\\Shop\\Model\\Leaf', False, False, False, False, False, False, False, False, False, False),
            ('app/code/Acme/Shop/Model/Many.php', 'Acme\\Shop\\Model\\Many', False, False, False, False, False, False, False, False, False, False),
            ('app/code/Acme/Shop/Model/Sql.php', 'Acme\\Shop\\Model\\Sql', False, False, False, False, False, False, False, False, False, False),
            ('app/code/Acme/Shop/Observer/Count.php', 'Acme\\Shop\\Observer\\Count', True, False, False, False, False, False, False, False, False, False),
            ('app/code/Acme/Shop/Observer/Notify.php', 'Acme\\Shop\\Observer\\Notify', False, False, False, True, False, False, False, False, False, False),
            ('app/code/Acme/Shop/Plugin/LogCart.php', 'Acme\\Shop\\Plugin\\LogCart', False, False, True, False, False, False, False, False, False, False),
            ('app/code/Acme/Shop/Setup/Install.php', 'Acme\\Shop\\Setup\\Install', False, False, False, False, False, False, False, True, False, False),
            ('app/code/Acme/Shop/Setup/Patch/Fill.php', 'Acme\\Shop\\Setup\\Patch\\Fill', False, False, False, False, False, False, False, True, False, False),
            ('app/code/Acme/Shop/Unit/CartTest.php', 'CartTest', False, False, False, False, False, False, False, False, False, False),
            ('app/code/Acme/Shop/Unit/ManyTest.php', 'ManyTest', False, False, False, False, False, False, False, False, False, False),
            ('lib/internal/Acme/Framework/Base.php', 'Acme\\Framework\\Base', False, False, False, False, False, False, False, False, False, False),
            ('vendor/acme/module-extra/Controller/Index/View.php', 'Acme\\Extra\\Controller\\Index\\View', True, False, False, False, False, False, False, False, False, False),
            ('vendor/acme/module-guard/Model/Chains.php', 'Acme\\Guard\\Model\\Chains', False, False, False, False, False, False, False, False, False, False),
        ],
    ),
    "sql_tables": (
        "path VARCHAR, table VARCHAR",
        [
            ('app/code/Acme/Shop/Model/Entity.php', 'shop_entity'),
            ('app/code/Acme/Shop/Model/Sql.php', 'shop_cart'),
            ('app/code/Acme/Shop/Model/Sql.php', 'shop_item'),
            ('app/code/Acme/Shop/Model/Sql.php', 'shop_order'),
            ('app/code/Acme/Shop/Model/Sql.php', 'shop_order_item'),
            ('app/code/Acme/Shop/Model/Sql.php', 'shop_rate'),
            ('app/code/Acme/Shop/Setup/Install.php', 'shop_named'),
            ('app/code/Acme/Shop/Setup/Install.php', 'shop_new'),
        ],
    ),
    "setup_tables": (
        "path VARCHAR, table VARCHAR, is_created BOOLEAN",
        [
            ('app/code/Acme/Shop/Model/Sql.php', 'shop_order', False),
            ('app/code/Acme/Shop/Setup/Install.php', 'shop_item', False),
            ('app/code/Acme/Shop/Setup/Install.php', 'shop_log', False),
            ('app/code/Acme/Shop/Setup/Install.php', 'shop_named', False),
            ('app/code/Acme/Shop/Setup/Install.php', 'shop_new', True),
            ('app/code/Acme/Shop/Setup/Install.php', 'shop_plain', True),
        ],
    ),
    "db_triggers": (
        "path VARCHAR, name VARCHAR, table VARCHAR, event VARCHAR, timing VARCHAR, statement VARCHAR",
        [
            ('app/code/Acme/Shop/Setup/Install.php', 'trg_cart', 'shop_cart', 'insert', 'after', None),
            ('app/code/Acme/Shop/Setup/Install.php', 'trg_item', 'itemTable', 'delete', 'before', 'INSERT INTO shop_log SELECT * FROM `shop_item` WHERE id = OLD.id'),
            ('app/code/Acme/Shop/Setup/Install.php', 'trg_old', None, 'dropped', None, None),
        ],
    ),
    "test_methods": (
        "path VARCHAR, test_method VARCHAR, covers VARCHAR, has_mock BOOLEAN",
        [
            ('app/code/Acme/Shop/Unit/CartTest.php', 'testLoad', '', True),
            ('app/code/Acme/Shop/Unit/CartTest.php', 'testSave', '', True),
            ('app/code/Acme/Shop/Unit/ManyTest.php', 'testMake', '\\Acme\\Shop\\Model\\Many::make', True),
        ],
    ),
    "js_modules": (
        "path VARCHAR, module_type VARCHAR, dependencies VARCHAR, classes VARCHAR, functions VARCHAR, is_ui_component BOOLEAN, is_widget BOOLEAN, is_mixin BOOLEAN, mixin_target VARCHAR, is_knockout BOOLEAN, component_name VARCHAR",
        [
            ('app/code/Acme/Shop/view/base/web/js/mixin.js', 'unknown', '', '', '', False, False, True, 'Acme_Shop/js/x', False, None),
            ('app/code/Acme/Shop/view/base/web/js/module.js', 'esm', 'jquery,Acme_Shop/js/x', 'Basket', 'total', False, False, False, None, False, None),
            ('app/code/Acme/Shop/view/base/web/js/node.js', 'commonjs', 'ko', '', 'first', False, False, False, None, True, None),
            ('app/code/Acme/Shop/view/base/web/js/once.js', 'iife', '', '', '', False, True, False, None, False, None),
            ('vendor/acme/module-extra/view/frontend/web/js/slider.js', 'amd', 'jquery,uiComponent', '', '', True, False, False, None, False, None),
        ],
    ),
    "js_exports": (
        "path VARCHAR, name VARCHAR",
        [
            ('app/code/Acme/Shop/view/base/web/js/module.js', 'Basket'),
            ('app/code/Acme/Shop/view/base/web/js/module.js', 'total'),
            ('app/code/Acme/Shop/view/base/web/js/node.js', 'second'),
        ],
    ),
    "di_arguments": (
        "target VARCHAR, arg VARCHAR, xsi_type VARCHAR, value VARCHAR, item VARCHAR, path VARCHAR",
        [
            ('Acme\\Shop\\Logger', 'file', 'string', 'shop.log', None, 'app/code/Acme/Shop/etc/di.xml'),
            ('Acme\\Shop\\Model\\Cart', 'limit', 'number', '25', None, 'app/code/Acme/Shop/etc/di.xml'),
            ('Acme\\Shop\\Model\\Pool', 'label', 'string', 'Pool', None, 'app/code/Acme/Shop/etc/frontend/di.xml'),
            ('Acme\\Shop\\Model\\Pool', 'modifiers', 'object', 'Acme\\Shop\\First', 'first', 'app/code/Acme/Shop/etc/frontend/di.xml'),
            ('Acme\\Shop\\Model\\Pool', 'modifiers', 'string', 'two', 'second', 'app/code/Acme/Shop/etc/frontend/di.xml'),
        ],
    ),
    "fieldsets": (
        "path VARCHAR, scope VARCHAR, fieldset VARCHAR, field VARCHAR, aspect VARCHAR",
        [
            ('app/code/Acme/Other/etc/fieldset.xml', 'admin', 'inner', 'c', 'to_d'),
            ('app/code/Acme/Other/etc/fieldset.xml', None, 'flat', 'a', 'to_b'),
            ('app/code/Acme/Ship/etc/fieldset.xml', 'global', 'sales_convert_quote', 'weight', 'to_order'),
            ('app/code/Acme/Shop/etc/fieldset.xml', 'global', 'convert_cart', 'note', 'to_order'),
            ('app/code/Acme/Shop/etc/fieldset.xml', 'global', 'convert_cart', 'total', 'to_order'),
            ('app/code/Acme/Shop/etc/fieldset.xml', 'global', 'convert_cart', 'total', 'to_quote'),
        ],
    ),
    "ctor_params": (
        "path VARCHAR, type_hint VARCHAR, variable VARCHAR",
        [
            ('app/code/Acme/Other/Base.php', '\\Acme\\Shop\\Api\\CartInterface', 'helper'),
            ('app/code/Acme/Shop/Model/Cart.php', 'ItemRepositoryInterface', 'items'),
            ('app/code/Acme/Shop/Model/Cart.php', '\\Acme\\Base\\Logger', 'logger'),
        ],
    ),
    "inheritance_resolve": (
        "fqcn VARCHAR, ancestor VARCHAR, depth BIGINT",
        [
            ('Acme\\Ship\\Model\\Carrier\\Flat', 'Acme\\Ship\\Model\\Carrier\\AbstractCarrier', 1),
            ('Acme\\Shop\\Helper\\Text', 'Acme\\Shop\\Helper\\AbstractHelper', 1),
            ('Acme\\Shop\\Model\\Base', 'Acme\\Other\\Base', 1),
            ('Acme\\Shop\\Model\\BaseCart', 'Acme\\Shop\\Model\\Entity', 1),
            ('Acme\\Shop\\Model\\Both', 'Acme\\Shop\\Api\\CartInterface', 1),
            ('Acme\\Shop\\Model\\Both', 'Countable', 1),
            ('Acme\\Shop\\Model\\Cart', 'Acme\\Shop\\Model\\BaseCart', 1),
            ('Acme\\Shop\\Model\\Cart', 'Acme\\Shop\\Model\\Entity', 2),
            ('Acme\\Shop\\Model\\Leaf', 'Acme\\Other\\Base', 3),
            ('Acme\\Shop\\Model\\Leaf', 'Acme\\Shop\\Model\\Base', 2),
            ('Acme\\Shop\\Model\\Leaf', 'Acme\\Shop\\Model\\Near', 1),
            ('Acme\\Shop\\Model\\Many', 'Acme\\Other\\Base', 1),
            ('Acme\\Shop\\Model\\Near', 'Acme\\Other\\Base', 2),
            ('Acme\\Shop\\Model\\Near', 'Acme\\Shop\\Model\\Base', 1),
            ('Acme\\Shop\\Model\\Pair', 'Acme\\Tools\\Box', 1),
        ],
    ),
    "class_lookup": (
        "name VARCHAR, fqcn VARCHAR, path VARCHAR",
        [
            ('Acme\\Shop\\Model\\Base', 'Acme\\Shop\\Model\\Base', 'app/code/Acme/Shop/Model/Base.php'),
            ('Base', 'Acme\\Other\\Base', 'app/code/Acme/Other/Base.php'),
            ('Elsewhere\\Cart', 'Acme\\Shop\\Model\\Cart', 'app/code/Acme/Shop/Model/Cart.php'),
            ('\\Acme\\Other\\Base', 'Acme\\Other\\Base', 'app/code/Acme/Other/Base.php'),
        ],
    ),
    "inherited_methods": (
        "fqcn VARCHAR, method VARCHAR, defined_in VARCHAR, path VARCHAR",
        [
            ('Acme\\Shop\\Model\\Leaf', 'shared', 'Acme\\Shop\\Model\\Base', 'app/code/Acme/Shop/Model/Base.php'),
            ('Acme\\Shop\\Model\\Leaf', 'start', 'Acme\\Shop\\Model\\Leaf', 'app/code/Acme/Shop/Model/Leaf.php'),
            ('Acme\\Shop\\Model\\Leaf', 'top', 'Acme\\Other\\Base', 'app/code/Acme/Other/Base.php'),
        ],
    ),
    "typed_calls": (
        "path VARCHAR, method VARCHAR, kind VARCHAR, property VARCHAR, callee VARCHAR, type_hint VARCHAR",
        [
            ('app/code/Acme/Other/Base.php', 'top', 'self', None, 'missing', None),
            ('app/code/Acme/Shop/Model/Base.php', 'shared', 'dependency', 'helper', 'load', '\\Acme\\Shop\\Api\\CartInterface'),
            ('app/code/Acme/Shop/Model/BaseCart.php', 'count', 'self', None, 'getConnection', None),
            ('app/code/Acme/Shop/Model/Cart.php', 'load', 'dependency', 'items', 'fetch', 'ItemRepositoryInterface'),
            ('app/code/Acme/Shop/Model/Cart.php', 'save', 'dependency', 'eventManager', 'dispatch', None),
            ('app/code/Acme/Shop/Model/Entity.php', 'table', 'dependency', 'res', 'getTableName', None),
            ('app/code/Acme/Shop/Model/Leaf.php', 'start', 'dependency', 'helper', 'load', '\\Acme\\Shop\\Api\\CartInterface'),
            ('app/code/Acme/Shop/Model/Leaf.php', 'start', 'self', None, 'shared', None),
            ('app/code/Acme/Shop/Model/Leaf.php', 'start', 'self', None, 'top', None),
            ('app/code/Acme/Shop/Model/Sql.php', 'run', 'dependency', 'config', 'getValue', None),
            ('app/code/Acme/Shop/Model/Sql.php', 'run', 'dependency', 'db', 'query', None),
            ('app/code/Acme/Shop/Model/Sql.php', 'run', 'dependency', 'res', 'getConnection', None),
            ('app/code/Acme/Shop/Model/Sql.php', 'run', 'dependency', 'res', 'getTable', None),
            ('app/code/Acme/Shop/Model/Sql.php', 'run', 'dependency', 'res', 'getTableName', None),
            ('app/code/Acme/Shop/Observer/Count.php', 'execute', 'dependency', 'bus', 'dispatch', None),
            ('app/code/Acme/Shop/Setup/Install.php', 'run', 'dependency', 'triggerFactory', 'create', None),
            ('app/code/Acme/Shop/Unit/CartTest.php', 'testLoad', 'self', None, 'createMock', None),
            ('app/code/Acme/Shop/Unit/ManyTest.php', 'testMake', 'self', None, 'getMockBuilder', None),
        ],
    ),
    "traced_calls": (
        "depth BIGINT, class VARCHAR, method VARCHAR, status VARCHAR, defined_in VARCHAR, trail VARCHAR",
        [
            (0, 'Gone', 'x', 'unresolved', None, 'Gone::x'),
            (0, 'Leaf', 'start', 'found', 'Acme\\Shop\\Model\\Leaf', 'Leaf::start'),
            (1, 'Acme\\Shop\\Model\\Cart', 'load', 'found', 'Acme\\Shop\\Model\\Cart', 'Leaf::start > Acme\\Shop\\Model\\Cart::load'),
            (1, 'Leaf', 'shared', 'found', 'Acme\\Shop\\Model\\Base', 'Leaf::start > Leaf::shared'),
            (1, 'Leaf', 'top', 'found', 'Acme\\Other\\Base', 'Leaf::start > Leaf::top'),
            (2, 'Acme\\Shop\\Model\\Cart', 'load', 'found', 'Acme\\Shop\\Model\\Cart', 'Leaf::start > Leaf::shared > Acme\\Shop\\Model\\Cart::load'),
            (2, 'Acme\\Shop\\Model\\ItemRepository', 'fetch', 'unresolved', None, 'Leaf::start > Acme\\Shop\\Model\\Cart::load > Acme\\Shop\\Model\\ItemRepository::fetch'),
            (2, 'Leaf', 'missing', 'method_not_found', None, 'Leaf::start > Leaf::top > Leaf::missing'),
        ],
    ),
    "api_bodies": (
        "url VARCHAR, http_method VARCHAR, impl VARCHAR, path VARCHAR, body VARCHAR",
        [
            ('/V1/carts/:id', 'GET', 'Acme\\Shop\\Model\\Cart', 'app/code/Acme/Shop/Model/Cart.php', '    public function load($id)\n    {\n        $row = $this->items->fetch($id);\n        if ($row && $row->isOpen() || $id > 3) {\n            $name = $order->getCustomer()->getName();\n        }\n        return $row;\n    }'),
        ],
    ),
    "config_consumers": (
        "config_path VARCHAR, path VARCHAR, class VARCHAR, constant VARCHAR",
        [
            ('shop/cart/limit', 'app/code/Acme/Shop/Model/Sql.php', 'Acme\\Shop\\Model\\Sql', 'PATH'),
        ],
    ),
    "implementors": (
        "name VARCHAR, match_type VARCHAR",
        [
            ('Acme\\Shop\\Model\\AdminCart', 'preference'),
            ('Acme\\Shop\\Model\\Cart', 'implements'),
            ('Acme\\Shop\\Model\\Cart', 'preference'),
            ('Acme\\Shop\\Model\\Many', 'implements'),
        ],
    ),
    "impact_counts": (
        "kind VARCHAR, n BIGINT",
        [
            ('constructor', 1),
            ('plugin', 1),
            ('preference', 1),
            ('total', 3),
        ],
    ),
    "search_rows": (
        "path VARCHAR, type VARCHAR, component_type VARCHAR, class_name VARCHAR, class_type VARCHAR, namespace VARCHAR, extends VARCHAR, implements VARCHAR, methods VARCHAR, method_name VARCHAR, flags VARCHAR",
        [
            ('app/code/Acme/Other/Base.php', 'php', 'other', 'Base', 'class', 'Acme\\Other', None, '', '__construct,top', '__construct', ''),
            ('app/code/Acme/Other/etc/fieldset.xml', 'xml', 'other', None, None, None, None, '', '', None, ''),
            ('app/code/Acme/Ship/Model/Carrier/Flat.php', 'php', 'model', 'Flat', 'class', 'Acme\\Ship\\Model\\Carrier', 'AbstractCarrier', '', 'collectRates', 'collectRates', ''),
            ('app/code/Acme/Ship/Model/RateModifier.php', 'php', 'model', 'RateModifier', 'class', 'Acme\\Ship\\Model', None, '', '', None, ''),
            ('app/code/Acme/Ship/Model/Total/Shipping.php', 'php', 'model', 'Shipping', 'class', 'Acme\\Ship\\Model\\Total', None, '', 'collect', 'collect', ''),
            ('app/code/Acme/Ship/Plugin/Rates.php', 'php', 'plugin', 'Rates', 'class', 'Acme\\Ship\\Plugin', None, '', 'afterCollectRates', 'afterCollectRates', 'plugin'),
            ('app/code/Acme/Ship/etc/db_schema.xml', 'xml', 'db_schema', None, None, None, None, '', '', None, ''),
            ('app/code/Acme/Ship/etc/di.xml', 'xml', 'di_config', None, None, None, None, '', '', None, ''),
            ('app/code/Acme/Ship/etc/fieldset.xml', 'xml', 'other', None, None, None, None, '', '', None, ''),
            ('app/code/Acme/Shop/Helper/Text.php', 'php', 'helper', 'Text', 'class', 'Acme\\Shop\\Helper', 'AbstractHelper', '', '', None, 'helper'),
            ('app/code/Acme/Shop/Model/Base.php', 'php', 'model', 'Base', 'class', 'Acme\\Shop\\Model', '\\Acme\\Other\\Base', '', 'shared', 'shared', ''),
            ('app/code/Acme/Shop/Model/BaseCart.php', 'php', 'model', 'BaseCart', 'class', 'Acme\\Shop\\Model', 'Entity', '', 'count', 'count', ''),
            ('app/code/Acme/Shop/Model/Cart.php', 'php', 'model', 'Cart', 'class', 'Acme\\Shop\\Model', 'BaseCart', 'CartInterface,\\Countable', '__construct,load,save', '__construct', ''),
            ('app/code/Acme/Shop/Model/Entity.php', 'php', 'model', 'Entity', 'class', 'Acme\\Shop\\Model', None, '', 'table', 'table', ''),
            ('app/code/Acme/Shop/Model/Leaf.php', 'php', 'model', 'Leaf', 'class', 'Acme\\Shop\\Model', 'Near', '', 'start', 'start', ''),
            ('app/code/Acme/Shop/Model/Many.php', 'php', 'model', 'Many', 'class', 'Acme\\Shop\\Model', 'OtherBase', 'CartInterface,\\Countable', 'make,later', 'make', ''),
            ('app/code/Acme/Shop/Model/Sql.php', 'php', 'model', 'Sql', 'class', 'Acme\\Shop\\Model', None, '', 'run', 'run', ''),
            ('app/code/Acme/Shop/Observer/Count.php', 'php', 'observer', 'Count', 'class', 'Acme\\Shop\\Observer', None, '', 'execute', 'execute', 'controller,observer'),
            ('app/code/Acme/Shop/Observer/Notify.php', 'php', 'observer', 'Notify', 'class', 'Acme\\Shop\\Observer', None, 'ObserverInterface', 'send', 'send', 'observer'),
            ('app/code/Acme/Shop/Plugin/LogCart.php', 'php', 'plugin', 'LogCart', 'class', 'Acme\\Shop\\Plugin', None, '', 'beforeLoad,afterLoad,aroundSave,help', 'beforeLoad', 'plugin'),
            ('app/code/Acme/Shop/Setup/Install.php', 'php', 'setup', 'Install', 'class', 'Acme\\Shop\\Setup', None, '', 'run', 'run', 'setup'),
            ('app/code/Acme/Shop/Setup/Patch/Fill.php', 'php', 'setup', 'Fill', 'class', 'Acme\\Shop\\Setup\\Patch', None, 'DataPatchInterface', '', None, 'setup'),
            ('app/code/Acme/Shop/Unit/CartTest.php', 'php', 'other', 'CartTest', 'class', None, None, '', 'testLoad,testSave', 'testLoad', ''),
            ('app/code/Acme/Shop/Unit/ManyTest.php', 'php', 'other', 'ManyTest', 'class', None, None, '', 'testMake', 'testMake', ''),
            ('app/code/Acme/Shop/etc/adminhtml/di.xml', 'xml', 'di_config', None, None, None, None, '', '', None, ''),
            ('app/code/Acme/Shop/etc/adminhtml/system.xml', 'xml', 'system_config', None, None, None, None, '', '', None, ''),
            ('app/code/Acme/Shop/etc/di.xml', 'xml', 'di_config', None, None, None, None, '', '', None, ''),
            ('app/code/Acme/Shop/etc/events.xml', 'xml', 'events_config', None, None, None, None, '', '', None, ''),
            ('app/code/Acme/Shop/etc/fieldset.xml', 'xml', 'other', None, None, None, None, '', '', None, ''),
            ('app/code/Acme/Shop/etc/frontend/di.xml', 'xml', 'di_config', None, None, None, None, '', '', None, ''),
            ('app/code/Acme/Shop/etc/schema.graphqls', 'graphql', 'graphql_schema', None, None, None, None, '', '', None, ''),
            ('app/code/Acme/Shop/etc/webapi.xml', 'xml', 'webapi_config', None, None, None, None, '', '', None, ''),
            ('app/code/Acme/Shop/view/base/web/js/mixin.js', 'javascript', 'javascript', None, None, None, None, '', '', None, 'mixin'),
            ('app/code/Acme/Shop/view/base/web/js/module.js', 'javascript', 'javascript', None, None, None, None, '', '', None, ''),
            ('app/code/Acme/Shop/view/base/web/js/node.js', 'javascript', 'javascript', None, None, None, None, '', '', None, ''),
            ('app/code/Acme/Shop/view/base/web/js/once.js', 'javascript', 'javascript', None, None, None, None, '', '', None, 'widget'),
            ('app/code/Acme/Shop/view/frontend/layout/cart_index.xml', 'xml', 'layout_config', None, None, None, None, '', '', None, ''),
            ('lib/internal/Acme/Framework/Base.php', 'php', 'other', 'Base', 'interface', 'Acme\\Framework', None, '', '', None, ''),
            ('vendor/acme/module-extra/Controller/Index/View.php', 'php', 'controller', 'View', 'class', 'Acme\\Extra\\Controller\\Index', None, '', 'execute', 'execute', 'controller'),
            ('vendor/acme/module-extra/view/frontend/web/js/slider.js', 'javascript', 'javascript', None, None, None, None, '', '', None, 'ui_component'),
            ('vendor/acme/module-guard/Model/Chains.php', 'php', 'model', 'Chains', 'class', 'Acme\\Guard\\Model', None, '', 'plain,over,safe,checks,compared,negated,chosen,merged,nulls', 'plain', ''),
        ],
    ),
    "search_texts": (
        "path VARCHAR, search_text VARCHAR, embed_text VARCHAR",
        [
            ('app/code/Acme/Shop/Helper/Text.php', 'Text text Acme Shop Helper helper utility data helper helper helper helper class data output helper utility data helper helper helper helper class data output abstract app code Acme acme Shop shop Helper helper Text.php text.php', 'Description: Cuts texts.\n\n<?php\nnamespace Acme\\Shop\\Helper;\n\nclass Text extends AbstractHelper {}\n class Text Text Text namespace Acme Shop Helper extends AbstractHelper helper helper helper utility data app code Acme Shop Helper Text.php Text text Acme Shop Helper helper utility data helper helper helper helper class data output helper utility data helper helper helper helper class data output abstract app code Acme acme Shop shop Helper helper Text.php text.php'),
            ('app/code/Acme/Shop/etc/frontend/di.xml', 'Acme\\Shop\\Model\\Pool di.xml di.xml di.xml dependency injection preference plugin type virtualType argument di.xml di.xml di.xml di.xml configuration dependency injection dependency injection plugin type configuration di.xml preference xml config configuration app code Acme acme Shop shop etc frontend di.xml', '<config>\n  <type name="Acme\\Shop\\Model\\Pool">\n    <arguments>\n      <argument xsi:type="string" name="label"> Pool </argument>\n      <argument name="modifiers" xsi:type="array">\n        <item name="first" xsi:type="object">Acme\\Shop\\First</item>\n        <item xsi:type="string" sortOrder="2" name="second">two</item>\n      </argument>\n    </arguments>\n  </type>\n</config> app code Acme Shop etc frontend di.xml Acme\\Shop\\Model\\Pool di.xml di.xml di.xml dependency injection preference plugin type virtualType argument di.xml di.xml di.xml di.xml configuration dependency injection dependency injection plugin type configuration di.xml preference xml config configuration app code Acme acme Shop shop etc frontend di.xml'),
            ('app/code/Acme/Shop/view/base/web/js/node.js', 'first ko app code Acme acme Shop shop view base web node.js', "const ko = require('ko');\nfunction first() {}\nexports.second = first;\nmodule.exports = { first };\n requires ko app code Acme Shop view base web node.js first ko app code Acme acme Shop shop view base web node.js"),
        ],
    ),
    "signal_gates": (
        "user_id BIGINT, event_id BIGINT, signal VARCHAR, search_id BIGINT",
        [
            (1, 2, 'refinement_to_plugin', 1),
            (1, 4, 'query_refinement', 1),
            (1, 7, 'trace_after_search', 6),
            (1, 8, 'refinement_to_config', 6),
            (2, 12, 'refinement_to_observer', 11),
            (2, 13, 'refinement_to_controller', 11),
            (2, 14, 'refinement_to_block', 11),
        ],
    ),
    "relevance": (
        "case_id BIGINT, qid BIGINT, id BIGINT, fits BOOLEAN, grade DOUBLE",
        [
            (0, 1, 1, True, 1.0),
            (0, 1, 2, False, 0.0),
            (0, 1, 2, False, 0.0),
            (0, 1, 3, True, 0.7),
            (0, 2, 4, False, 0.0),
            (0, 2, 5, False, 0.0),
            (0, 3, 6, True, 1.0),
            (1, 1, 1, True, 0.25),
            (1, 1, 2, True, 0.5),
            (1, 1, 2, True, 0.5),
            (1, 1, 3, True, 0.25),
            (1, 2, 4, False, 0.0),
            (1, 2, 5, False, 0.0),
            (1, 3, 6, True, 0.25),
            (2, 1, 1, True, 0.75),
            (2, 1, 2, False, 0.25),
            (2, 1, 2, False, 0.25),
            (2, 1, 3, False, 0.25),
            (2, 2, 4, True, 1.0),
            (2, 2, 5, False, 0.25),
            (2, 3, 6, False, 0.25),
            (3, 1, 1, False, 0.0),
            (3, 1, 2, True, 0.0),
            (3, 1, 2, True, 0.0),
            (3, 1, 3, False, 0.0),
            (3, 2, 4, False, 0.0),
            (3, 2, 5, False, 0.0),
            (3, 3, 6, False, 0.0),
            (4, 1, 1, False, 0.0),
            (4, 1, 2, False, 0.0),
            (4, 1, 2, False, 0.0),
            (4, 1, 3, True, 1.0),
            (4, 2, 4, False, 0.0),
            (4, 2, 5, False, 0.0),
            (4, 3, 6, True, 1.0),
            (5, 1, 1, False, 0.0),
            (5, 1, 2, False, 0.0),
            (5, 1, 2, False, 0.0),
            (5, 1, 3, False, 0.0),
            (5, 2, 4, False, 0.0),
            (5, 2, 5, False, 0.0),
            (5, 3, 6, False, 0.0),
        ],
    ),
    "pattern_pass": (
        "case_id BIGINT, missed VARCHAR, expected_hits BIGINT, unexpected_hits BIGINT, top_score DOUBLE, passed BOOLEAN",
        [
            (1, 'cart', 1, 1, 0.5, False),
            (2, 'cart', 1, 0, 0.5, True),
            (3, 'cart,plugin,tax', 0, 0, 0.5, False),
            (4, '', 2, 0, 0.5, False),
            (5, 'plugin,tax', 0, 1, 0.5, False),
            (6, 'rate,tax', 0, 0, 0.1, False),
        ],
    ),
    "missed_patterns": (
        "pattern VARCHAR, n BIGINT",
        [
            ('tax', 3),
        ],
    ),
    "diff_risk": (
        "path VARCHAR, added BIGINT, removed BIGINT, risk DOUBLE",
        [
            ('a/Model/X.php', 150, 100, 1.0),
            ('a/Model/Z.php', 0, 1, 0.005),
            ('a/Plugin/Y.php', 0, 0, 0.3),
            ('a/etc/di.xml', 2, 1, 0.315),
        ],
    ),
    "glob_scan": (
        "path VARCHAR",
        [
            ('app/code/Acme/Ship/etc/di.xml',),
            ('app/code/Acme/Shop/Helper/Text.php',),
            ('app/code/Acme/Shop/Observer/Count.php',),
            ('app/code/Acme/Shop/Observer/Notify.php',),
            ('app/code/Acme/Shop/etc/adminhtml/di.xml',),
            ('app/code/Acme/Shop/etc/di.xml',),
            ('app/code/Acme/Shop/etc/frontend/di.xml',),
            ('vendor/acme/module-extra/Controller/Index/View.php',),
        ],
    ),
    "class_candidates": (
        "name VARCHAR, place BIGINT, path VARCHAR",
        [
            ('A\\\\B\\\\C', 0, 'vendor/a/B/C.php'),
            ('A\\\\B\\\\C', 1, 'vendor/a/b/C.php'),
            ('A\\\\B\\\\C', 2, 'app/code/A/B/C.php'),
            ('Acme\\ShopCart\\Model\\Item', 0, 'vendor/acme/ShopCart/Model/Item.php'),
            ('Acme\\ShopCart\\Model\\Item', 1, 'vendor/acme/shop-cart/Model/Item.php'),
            ('Acme\\ShopCart\\Model\\Item', 2, 'app/code/Acme/ShopCart/Model/Item.php'),
        ],
    ),
    "pascal_names": (
        "id BIGINT, pascal VARCHAR",
        [
            (1, 'PriceList'),
            (2, 'Sku'),
            (3, 'IsoCodeA'),
            (4, ''),
        ],
    ),
    "safe_versions": (
        "id BIGINT, ok BOOLEAN",
        [
            (1, True),
            (2, True),
            (3, False),
            (4, False),
            (5, False),
        ],
    ),
    "grep_include": (
        "path VARCHAR, line BIGINT",
        [
            ('app/code/Acme/Other/Base.php', 12),
            ('app/code/Acme/Other/Base.php', 6),
            ('app/code/Acme/Shop/Model/Cart.php', 13),
            ('app/code/Acme/Shop/Model/Cart.php', 8),
            ('app/code/Acme/Shop/Observer/Count.php', 6),
            ('app/code/Acme/Shop/Unit/CartTest.php', 4),
            ('app/code/Acme/Shop/Unit/CartTest.php', 5),
            ('vendor/acme/module-guard/Model/Chains.php', 14),
            ('vendor/acme/module-guard/Model/Chains.php', 27),
            ('vendor/acme/module-guard/Model/Chains.php', 35),
            ('vendor/acme/module-guard/Model/Chains.php', 49),
            ('vendor/acme/module-guard/Model/Chains.php', 6),
            ('vendor/acme/module-guard/Model/Chains.php', 62),
            ('vendor/acme/module-guard/Model/Chains.php', 74),
            ('vendor/acme/module-guard/Model/Chains.php', 86),
            ('vendor/acme/module-guard/Model/Chains.php', 98),
        ],
    ),
    "grep_context": (
        "path VARCHAR, first BIGINT, last BIGINT, n_matches BIGINT, text VARCHAR",
        [
            ('app/code/Acme/Shop/Model/BaseCart.php', 4, 8, 1, 'abstract class BaseCart extends Entity\n{\n    public function count() { return $this->getConnection()->fetchOne("SELECT count(*) FROM shop_cart JOIN shop_item USING (id) WHERE open = 1"); }\n}\n'),
            ('app/code/Acme/Shop/Model/Cart.php', 15, 24, 2, "        $row = $this->items->fetch($id);\n        if ($row && $row->isOpen() || $id > 3) {\n            $name = $order->getCustomer()->getName();\n        }\n        return $row;\n    }\n\n    protected function save()\n    {\n        $this->eventManager->dispatch('cart_saved', ['cart' => $this]);"),
        ],
    ),
    "tool_find_class": (
        "fqcn VARCHAR, path VARCHAR",
        [
            ('Acme\\Framework\\Base', 'lib/internal/Acme/Framework/Base.php'),
            ('Acme\\Other\\Base', 'app/code/Acme/Other/Base.php'),
            ('Acme\\Shop\\Model\\Base', 'app/code/Acme/Shop/Model/Base.php'),
            ('Acme\\Shop\\Model\\BaseCart', 'app/code/Acme/Shop/Model/BaseCart.php'),
        ],
    ),
    "tool_find_method": (
        "path VARCHAR, method VARCHAR, visibility VARCHAR, body VARCHAR",
        [
            ('app/code/Acme/Shop/Model/Cart.php', 'load', 'public', '    public function load($id)\n    {\n        $row = $this->items->fetch($id);\n        if ($row && $row->isOpen() || $id > 3) {\n            $name = $order->getCustomer()->getName();\n        }\n        return $row;\n    }'),
            ('app/code/Acme/Shop/Plugin/LogCart.php', 'afterLoad', 'public', '    public function afterLoad($subject, $result) { return $result; }'),
            ('app/code/Acme/Shop/Plugin/LogCart.php', 'beforeLoad', 'public', '    public function beforeLoad($subject, $id) { return [$id]; }'),
            ('app/code/Acme/Shop/Unit/CartTest.php', 'testLoad', 'public', '    public function testLoad() { $m = $this->createMock(Cart::class); }'),
        ],
    ),
    "tool_find_plugin": (
        "target VARCHAR, name VARCHAR, plugin_class VARCHAR, type VARCHAR, target_method VARCHAR, body VARCHAR",
        [
            ('Acme\\Shop\\Model\\Cart', 'log_cart', 'Acme\\Shop\\Plugin\\LogCart', 'after', 'load', '    public function afterLoad($subject, $result) { return $result; }'),
            ('Acme\\Shop\\Model\\Cart', 'log_cart', 'Acme\\Shop\\Plugin\\LogCart', 'around', 'save', '    public function aroundSave($subject, callable $next) { return $next(); }'),
            ('Acme\\Shop\\Model\\Cart', 'log_cart', 'Acme\\Shop\\Plugin\\LogCart', 'before', 'load', '    public function beforeLoad($subject, $id) { return [$id]; }'),
            ('Acme\\Shop\\Model\\Cart', 'old_cart', 'Acme\\Shop\\Plugin\\OldCart', None, None, None),
        ],
    ),
    "tool_find_observer": (
        "name VARCHAR, instance VARCHAR, method VARCHAR",
        [
            ('count', 'Acme\\Shop\\Observer\\Count', 'execute'),
            ('notify', 'Acme\\Shop\\Observer\\Notify', 'send'),
        ],
    ),
    "tool_find_api": (
        "url VARCHAR, service_method VARCHAR",
        [
            ('/V1/carts/:id', 'load'),
        ],
    ),
    "tool_find_graphql": (
        "op VARCHAR, resolver_class VARCHAR",
        [
            ('items', 'Acme\\Shop\\Model\\Resolver\\Items'),
        ],
    ),
    "tool_find_db_schema": (
        "path VARCHAR, component_type VARCHAR",
        [
            ('app/code/Acme/Shop/Setup/Install.php', 'setup'),
        ],
    ),
    "tool_find_trigger": (
        "name VARCHAR, event VARCHAR, timing VARCHAR",
        [
            ('trg_cart', 'insert', 'after'),
        ],
    ),
    "tool_find_table_usage": (
        "path VARCHAR, usage VARCHAR",
        [
            ('app/code/Acme/Ship/etc/db_schema.xml', 'schema'),
            ('app/code/Acme/Shop/Model/Sql.php', 'code'),
            ('app/code/Acme/Shop/Setup/Install.php', 'setup'),
        ],
    ),
    "tool_module_structure": (
        "category VARCHAR, n BIGINT",
        [
            ('configs', 8),
            ('controllers', 1),
            ('models', 7),
            ('observers', 2),
            ('other', 10),
            ('plugins', 1),
        ],
    ),
    "tool_analyze_diff": (
        "path VARCHAR, added BIGINT, removed BIGINT, risk DOUBLE",
        [
            ('a/Model/X.php', 150, 100, 1.0),
            ('a/Model/Z.php', 0, 1, 0.005),
            ('a/Plugin/Y.php', 0, 0, 0.3),
            ('a/etc/di.xml', 2, 1, 0.315),
            (None, 152, 102, 1.0),
        ],
    ),
    "tool_complexity": (
        "path VARCHAR, complexity BIGINT, rating VARCHAR",
        [
            ('app/code/Acme/Shop/Model/Cart.php', 5, 'low'),
            ('app/code/Acme/Shop/etc/di.xml', 3, 'low'),
            ('vendor/acme/module-guard/Model/Chains.php', 6, 'moderate'),
        ],
    ),
    "tool_find_fieldset": (
        "fieldset VARCHAR, aspect VARCHAR, fields VARCHAR",
        [
            ('convert_cart', 'to_order', 'note,total'),
            ('sales_convert_quote', 'to_order', 'weight'),
        ],
    ),
    "tool_trace_shipping_chain": (
        "part VARCHAR, name VARCHAR, path VARCHAR, detail VARCHAR",
        [
            ('carrier', 'Flat', 'app/code/Acme/Ship/Model/Carrier/Flat.php', 'collectRates'),
            ('fieldset', 'sales_convert_quote/weight', 'app/code/Acme/Ship/etc/fieldset.xml', 'to_order'),
            ('modifier', 'RateModifier', 'app/code/Acme/Ship/Model/RateModifier.php', ''),
            ('plugin', 'rates', 'app/code/Acme/Ship/etc/di.xml', 'after:collectRates'),
            ('total', 'Shipping', 'app/code/Acme/Ship/Model/Total/Shipping.php', 'collect'),
        ],
    ),
    "tool_trace_dependency": (
        "kind VARCHAR, name VARCHAR, path VARCHAR",
        [
            ('resolves_to', 'Acme\\Shop\\Model\\AdminCart', 'app/code/Acme/Shop/etc/adminhtml/di.xml'),
            ('resolves_to', 'Acme\\Shop\\Model\\Cart', 'app/code/Acme/Shop/etc/di.xml'),
            ('used_by', 'helper', 'app/code/Acme/Other/Base.php'),
        ],
    ),
    "tool_error_parser": (
        "error_type VARCHAR, subject VARCHAR, frames VARCHAR",
        [
            ('missing_class', 'A\\B', 'x/y.php:7'),
        ],
    ),
    "tool_find_layout": (
        "handle VARCHAR, kind VARCHAR, name VARCHAR",
        [
            ('cart_index', 'block', 'cart.list'),
            ('cart_index', 'container', 'cart.top'),
        ],
    ),
    "tool_find_test": (
        "path VARCHAR, test_method VARCHAR",
        [
            ('app/code/Acme/Shop/Unit/ManyTest.php', 'testMake'),
        ],
    ),
    "tool_find_callers": (
        "path VARCHAR, line BIGINT, method VARCHAR, names_class BOOLEAN",
        [
            ('app/code/Acme/Shop/Model/Base.php', 6, 'shared', False),
            ('app/code/Acme/Shop/Model/Leaf.php', 10, 'start', True),
            ('app/code/Acme/Shop/etc/webapi.xml', 2, None, False),
        ],
    ),
    "tool_find_di_wiring": (
        "kind VARCHAR, subject VARCHAR, value VARCHAR, path VARCHAR",
        [
            ('argument', 'Acme\\Shop\\Model\\Cart', 'limit=25', 'app/code/Acme/Shop/etc/di.xml'),
            ('constructor', '\\Acme\\Shop\\Api\\CartInterface', 'helper', 'app/code/Acme/Other/Base.php'),
            ('plugin', 'Acme\\Shop\\Model\\Cart', 'Acme\\Shop\\Plugin\\LogCart', 'app/code/Acme/Shop/etc/di.xml'),
            ('plugin', 'Acme\\Shop\\Model\\Cart', 'Acme\\Shop\\Plugin\\OldCart', 'app/code/Acme/Shop/etc/di.xml'),
            ('preference', 'Acme\\Shop\\Api\\CartInterface', 'Acme\\Shop\\Model\\AdminCart', 'app/code/Acme/Shop/etc/adminhtml/di.xml'),
            ('preference', 'Acme\\Shop\\Api\\CartInterface', 'Acme\\Shop\\Model\\Cart', 'app/code/Acme/Shop/etc/di.xml'),
        ],
    ),
    "tool_trace_data_flow": (
        "path VARCHAR, line BIGINT, kind VARCHAR, method VARCHAR",
        [
            ('app/code/Acme/Shop/Model/Cart.php', 25, 'setter', 'save'),
            ('vendor/acme/module-guard/Model/Chains.php', 100, 'setter', 'nulls'),
        ],
    ),
    "tool_find_event_dispatchers": (
        "path VARCHAR, line BIGINT, method VARCHAR, n_observers BIGINT",
        [
            ('app/code/Acme/Shop/Model/Cart.php', 24, 'save', 2),
        ],
    ),
    "tool_grep": (
        "path VARCHAR, n_matches BIGINT",
        [
            ('app/code/Acme/Shop/Model/Base.php', 1),
            ('app/code/Acme/Shop/Model/BaseCart.php', 1),
            ('app/code/Acme/Shop/Model/Cart.php', 1),
            ('app/code/Acme/Shop/Model/Leaf.php', 1),
            ('app/code/Acme/Shop/Model/Many.php', 4),
        ],
    ),
    "tool_ast_search": (
        "path VARCHAR, line BIGINT",
        [
            ('app/code/Acme/Shop/Model/Base.php', 6),
            ('app/code/Acme/Shop/Model/Cart.php', 15),
            ('app/code/Acme/Shop/Model/Cart.php', 24),
            ('app/code/Acme/Shop/Model/Entity.php', 6),
            ('app/code/Acme/Shop/Model/Leaf.php', 10),
            ('app/code/Acme/Shop/Model/Sql.php', 11),
            ('app/code/Acme/Shop/Model/Sql.php', 12),
            ('app/code/Acme/Shop/Model/Sql.php', 13),
            ('app/code/Acme/Shop/Model/Sql.php', 13),
            ('app/code/Acme/Shop/Model/Sql.php', 15),
        ],
    ),
    "tool_find_null_risks": (
        "second_method VARCHAR, n_sites BIGINT",
        [
            ('ten', 2),
        ],
    ),
    "tool_trace_config": (
        "config_path VARCHAR, label VARCHAR, env VARCHAR, scope VARCHAR, value VARCHAR, consumers VARCHAR",
        [
            ('shop/cart/limit', 'Cart limit', 'live', 'default', '25', 'Acme\\Shop\\Model\\Sql'),
            ('shop/cart/limit', 'Cart limit', 'live', 'stores', '30', 'Acme\\Shop\\Model\\Sql'),
            ('shop/cart/limit', 'Cart limit', 'stage', 'default', '5', 'Acme\\Shop\\Model\\Sql'),
        ],
    ),
    "tool_read": (
        "line BIGINT, text VARCHAR",
        [
            (22, '    protected function save()'),
            (23, '    {'),
            (24, "        $this->eventManager->dispatch('cart_saved', ['cart' => $this]);"),
            (25, '        $item->setPrice(null);'),
            (26, '        if ($quote->getAddress() !== null) {'),
            (27, '            $c = $quote->getAddress()->getCity();'),
            (28, '        }'),
            (29, '        $x = $pay?->getMethod()?->getTitle();'),
            (30, '    }'),
        ],
    ),
    "tool_stats": (
        "n_live BIGINT, n_deleted BIGINT, n_files BIGINT",
        [
            (41, 0, 41),
        ],
    ),
}
